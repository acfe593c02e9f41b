"""Memory estimates, the limit, eviction and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes that an entry takes besides its key and value, and that a deadline adds: our estimate.
ENTRY_BYTES, DEADLINE_BYTES = 64, 24
BUCKETS = 4096
#: Entries that are put in order in one task at most; ranges that hold more are cut finer first.
EDGE_ROWS = 100_000
#: The eviction policies.
POLICIES = ("noeviction", "allkeys-lru", "volatile-lru", "allkeys-random", "volatile-random", "volatile-ttl", "allkeys-lfu", "volatile-lfu")


def cost() -> Column:
    return (F.octet_length("key") + F.coalesce(F.octet_length("val"), F.lit(0)) + ENTRY_BYTES + F.when(F.col("expire_at_ms").isNotNull(), DEADLINE_BYTES).otherwise(0)).cast("long")


def usage(k: DataFrame) -> DataFrame:
    return k.groupBy("db").agg(F.count("*").alias("keys"), F.sum(cost()).alias("bytes"))


def over_limit(k: DataFrame, limit: int, policy: str) -> DataFrame:
    """(bytes, refuse): whether a write is refused, for want of anything the policy may evict."""
    rows = k.agg(F.coalesce(F.sum(cost()), F.lit(0)).alias("bytes"), F.count("expire_at_ms").alias("timed"))
    stuck = F.lit(policy == "noeviction") | (F.lit(policy.startswith("volatile-")) & (F.col("timed") == 0))
    return rows.select("bytes", ((F.col("bytes") > limit) & stuck).alias("refuse"))


def score(policy: str, now_ms: int, seed: str = "evict") -> Column:
    """Larger goes first."""
    kind = policy.partition("-")[2]
    if kind == "lru":
        return (F.lit(now_ms) - F.col("access_ms")).cast("long")
    if kind == "lfu":
        return (255 - F.col("freq")).cast("long")
    if kind == "ttl":
        return (-F.col("expire_at_ms")).cast("long")
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("key"))), 1, 15), 16, 10).cast("long")


def evict(k: DataFrame, policy: str, excess: int, now_ms: int) -> DataFrame:
    """(db, key, score, bytes) of the entries to evict: by score, then key and database, as many as free ``excess`` bytes. LFU policies need a column ``freq``.

    Exact, without a global sort: bytes by ranges of scores tell in which range the running sum crosses the excess; entries of earlier ranges go as
    they are, and that range is cut finer, by scores and then by the keys' first characters, until it is small enough to be put in order.
    """
    if policy not in POLICIES:
        raise ValueError(policy)
    if policy == "noeviction":
        return k.filter(F.lit(False)).select("db", "key", F.lit(0).cast("long").alias("score"), cost().alias("bytes"))
    rows = k.filter("expire_at_ms IS NOT NULL") if policy.startswith("volatile-") else k
    rows = rows.select("db", "key", score(policy, now_ms).alias("score"), cost().alias("bytes"))
    span = rows.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    if span["lo"] is None or excess <= 0:
        return rows.filter(F.lit(False))
    width = (span["hi"] - span["lo"]) // BUCKETS + 1
    rows = rows.withColumn("bucket", F.floor((F.lit(span["hi"]) - F.col("score")) / F.lit(width)).cast("long"))
    sums = {r["bucket"]: r["bytes"] for r in rows.groupBy("bucket").agg(F.sum("bytes").alias("bytes")).collect()}  # at most BUCKETS rows
    edge, freed = _crossing(sums, excess)
    if edge is None:
        return rows.drop("bucket")
    sure, last = rows.filter(F.col("bucket") < edge).drop("bucket"), rows.filter(F.col("bucket") == edge).drop("bucket")
    while width > 1 and last.count() > EDGE_ROWS:  # scores within the range, finer
        top = last.agg(F.max("score")).first()[0]
        width = max(1, width // BUCKETS)
        place = F.floor((F.lit(top) - F.col("score")) / F.lit(width)).cast("long")
        sums = {r["b"]: r["bytes"] for r in last.groupBy(place.alias("b")).agg(F.sum("bytes").alias("bytes")).collect()}
        edge, less = _crossing(sums, excess - freed)
        sure, last, freed = sure.union(last.filter(place < edge)), last.filter(place == edge), freed + less
    prefix = F.lit("")
    for size in range(1, 1 << 20):  # many equal scores: by the keys' first characters, one more each time
        if width > 1 or last.count() <= EDGE_ROWS:
            break
        prefix = F.substring("key", 1, size)
        sums = {r["p"]: r["bytes"] for r in last.groupBy(prefix.alias("p")).agg(F.sum("bytes").alias("bytes")).collect()}
        if len(sums) == 1 and last.filter(F.length("key") > size).isEmpty():
            break  # one key in several databases
        edge, less = _crossing(sums, excess - freed)
        sure, last, freed = sure.union(last.filter(prefix < edge)), last.filter(prefix == edge), freed + less
    before = F.sum("bytes").over(W.orderBy(F.desc("score"), "key", "db").rowsBetween(W.unboundedPreceding, -1))
    last = last.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < excess - freed)
    return sure.union(last.drop("before"))


def _crossing(sums: dict, excess: int) -> tuple:
    """The first place, in order, at which the running sum reaches the excess, and the sum before it; no place if it never does."""
    freed = 0
    for place in sorted(sums):
        if freed + sums[place] >= excess:
            return place, freed
        freed += sums[place]
    return None, freed


def active_expire(k: DataFrame, now_ms: int) -> DataFrame:
    """(db, key, event) for every key past its deadline."""
    return k.filter(F.col("expire_at_ms") <= now_ms).select("db", "key", F.lit("expired").alias("event"))


#: A new key's counter, and its largest value.
FREQ_START, FREQ_MOST = 5, 255


def freq_decayed(freq: Column, minutes: Column, per: int = 1) -> Column:
    """The counter after idle minutes: one less for each ``per`` of them."""
    return F.greatest(freq - F.floor(minutes / per).cast("int"), F.lit(0)) if per else freq


def freq_expected(accesses: Column, factor: int = 10) -> Column:
    """The expected counter after that many accesses (each raises c with chance 1 / ((c - start) * factor + 1)); a deterministic stand-in for the random one."""
    steps = accesses / F.lit(float(factor))
    return F.least(F.lit(FREQ_MOST), F.floor(FREQ_START + F.sqrt(steps * 2 + 0.25) - 0.5).cast("int"))
