"""Operators on the keyspace table (db, key, type, val, expire_at_ms, access_ms).

All take the moment as an argument. A row is gone once its deadline is at or before that moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import scalars

#: Fixed value: clocks of idle times wrap at 24 bits of seconds.
CLOCK = 1 << 24


#: Bytes of the files read for each partition that rows are dealt to.
SHARE = 1 << 20
#: Sizes from here on stand for rows whose size the planner does not know.
UNKNOWN = 1 << 60


def dealt(*tables: DataFrame, by: str = "key") -> tuple[DataFrame, ...]:
    """The tables dealt by a column, all alike, to partitions whose number follows the size of what they are read from: a task's sorts and hash tables then hold as much however large the tables are."""
    spark, sizes = tables[0].sparkSession, []
    for rows in tables:
        leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes += [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = [x for x in sizes if x < UNKNOWN]
    n = max(sum(known) // SHARE + 1, int(spark.conf.get("spark.sql.shuffle.partitions")) if len(known) < len(sizes) else 1)
    return tuple(rows.repartition(n, by) for rows in tables)


def live(k: DataFrame, now_ms: int) -> DataFrame:
    return k.filter(F.col("expire_at_ms").isNull() | (F.col("expire_at_ms") > now_ms))


def probe(k: DataFrame, keys: DataFrame, now_ms: int, *columns: str, db: int = 0) -> DataFrame:
    """Every row of ``keys`` (key, and whatever it carries) with the columns of its live key, or nulls."""
    found = live(k, now_ms).filter(F.col("db") == db).select("key", F.lit(True).alias("found"), *columns)
    return keys.join(found, "key", "left")


def get(k: DataFrame, keys: DataFrame, now_ms: int, db: int = 0) -> DataFrame:
    """Value, or null; ``wrong_type`` where the key holds something else."""
    rows = probe(k, keys, now_ms, "type", "val", db=db)
    return rows.withColumn("wrong_type", F.coalesce(F.col("type") != "string", F.lit(False))).withColumn("val", F.when(F.col("type") == "string", F.col("val"))).drop("found", "type")


def mget(k: DataFrame, keys: DataFrame, now_ms: int, db: int = 0) -> DataFrame:
    """(ordinal, key, val) for every row of ``keys`` (ordinal, key); null for missing keys and other types."""
    return get(k, keys, now_ms, db).select("ordinal", "key", "val")


def strlen(values: DataFrame) -> DataFrame:
    return values.select("key", F.octet_length("val").cast("long").alias("n_bytes"))


def exists(k: DataFrame, keys: DataFrame, now_ms: int, db: int = 0) -> DataFrame:
    """How many of ``keys`` are live; repeated keys count each time."""
    return keys.join(live(k, now_ms).filter(F.col("db") == db), "key", "left_semi").agg(F.count("*").alias("n"))


def type_of(k: DataFrame, keys: DataFrame, now_ms: int, db: int = 0) -> DataFrame:
    return probe(k, keys, now_ms, "type", db=db).select("key", F.coalesce("type", F.lit("none")).alias("type"))


def _times(k: DataFrame, keys: DataFrame, now_ms: int, with_deadline: dict[str, Column], db: int) -> DataFrame:
    rows = probe(k, keys, now_ms, "expire_at_ms", db=db)
    at = F.col("expire_at_ms")
    return rows.select("key", *(F.when(F.col("found").isNull(), -2).when(at.isNull(), -1).otherwise(v).cast("long").alias(n) for n, v in with_deadline.items()))


def ttl(k: DataFrame, keys: DataFrame, now_ms: int, db: int = 0) -> DataFrame:
    """Time left in milliseconds and in rounded seconds; -1 without a deadline, -2 without a key."""
    rest = F.col("expire_at_ms") - now_ms
    return _times(k, keys, now_ms, {"ttl": F.floor((rest + 500) / 1000), "pttl": rest}, db)


def expiretime(k: DataFrame, keys: DataFrame, now_ms: int, db: int = 0) -> DataFrame:
    at = F.col("expire_at_ms")
    return _times(k, keys, now_ms, {"expiretime": F.floor((at + 500) / 1000), "pexpiretime": at}, db)


def match_keys(k: DataFrame, pattern: str, now_ms: int, db: int = 0) -> DataFrame:
    return live(k, now_ms).filter((F.col("db") == db) & scalars.glob(F.col("key"), pattern))


def random_key(k: DataFrame, now_ms: int, seed: str, db: int = 0) -> DataFrame:
    """A live key drawn by a seeded hash."""
    spot = F.md5(F.concat(F.lit(seed), F.col("key")))
    return live(k, now_ms).filter(F.col("db") == db).agg(F.min_by("key", spot).alias("key"))


def scan(k: DataFrame, now_ms: int, *, shards: int, bits: int, shard: int | None = None, bucket: int | None = None, pattern: str = "*", kind: str | None = None, db: int = 0) -> DataFrame:
    """Live keys with their shard, bucket and the cursor that leads to their bucket; one shard's bucket, or all.

    Buckets are visited in the order of their reversed bits, so a table that doubles its buckets splits those that were seen
    already into buckets that come at the same place. A cursor is ``place << log2(shards) | shard``.
    """
    rows = live(k, now_ms).filter((F.col("db") == db) & scalars.glob(F.col("key"), pattern))
    if kind is not None:
        rows = rows.filter(F.col("type") == kind)
    rows = rows.withColumn("slot", scalars.slot(F.col("key")))
    low = shards.bit_length() - 1
    rows = rows.withColumn("shard", F.col("slot").bitwiseAND(shards - 1)).withColumn("bucket", F.shiftright("slot", low).bitwiseAND((1 << bits) - 1))
    if shard is not None:
        rows = rows.filter(F.col("shard") == shard)
    if bucket is not None:
        rows = rows.filter(F.col("bucket") == bucket)
    cursor = F.shiftleft(scalars.reversed_bits(F.col("bucket"), bits), low).bitwiseOR(F.col("shard").cast("long"))
    return rows.select("key", "shard", "bucket", cursor.alias("cursor"))


def scan_page(k: DataFrame, now_ms: int, cursor: int, *, count: int = 10, shards: int, bits: int, pattern: str = "*", kind: str | None = None, db: int = 0) -> tuple[DataFrame, int]:
    """(key) of the buckets from a cursor on until ``count`` live entries are examined, whole buckets at a time, and the cursor to go on from (0 at the end).

    Shards come one after another, a shard's buckets in the order of their places. ``pattern`` and ``kind`` choose among the entries examined. A key that stays is returned at least once, whatever
    else is set or deleted between pages. The driver gets at most one row a bucket.
    """
    rows = scan(k, now_ms, shards=shards, bits=bits, db=db)
    low = shards.bit_length() - 1
    spot = lambda shard, place: shard * (1 << bits) + place
    at = (F.col("shard") * (1 << bits) + F.shiftright("cursor", low)).cast("long")
    start = spot(cursor & (shards - 1), cursor >> low)
    rows = rows.withColumn("at", at).filter(F.col("at") >= start)
    if shards * (1 << bits) <= start:
        return rows.select("key").filter(F.lit(False)), 0
    sizes = sorted((r["at"], r["count"]) for r in rows.groupBy("at").count().collect())
    seen, stop = 0, None
    for place, n in sizes:
        if seen >= count:
            stop = place
            break
        seen += n
    page = rows if stop is None else rows.filter(F.col("at") < stop)
    page = page.filter(scalars.glob(F.col("key"), pattern))
    if kind is not None:
        page = page.join(live(k, now_ms).filter((F.col("db") == db) & (F.col("type") == kind)).select("key"), "key", "left_semi")
    if stop is None:
        return page.select("key"), 0
    shard, place = divmod(stop, 1 << bits)
    return page.select("key"), place << low | shard


def dbsize(k: DataFrame, db: int = 0) -> DataFrame:
    """Rows of a database, keys past their deadline included until they are removed."""
    return k.filter(F.col("db") == db).agg(F.count("*").alias("n"))


def object_info(k: DataFrame, now_ms: int, db: int = 0, policy: str = "noeviction") -> DataFrame:
    """Encoding, reference count and idle seconds of live string keys; idle times are not kept under a policy by frequency."""
    if policy.endswith("lfu"):
        raise ValueError("An LFU maxmemory policy is selected, idle time not tracked.")
    rows = live(k, now_ms).filter((F.col("db") == db) & (F.col("type") == "string"))
    small = scalars.strict_long(F.col("val")).between(0, 9999) & (scalars.encoding(F.col("val")) == "int")
    idle = F.pmod(F.floor(F.lit(now_ms) / 1000) - F.floor(F.col("access_ms") / 1000), F.lit(CLOCK))
    return rows.select("key", scalars.encoding(F.col("val")).alias("encoding"), F.when(small, 2147483647).otherwise(1).alias("refcount"), idle.cast("long").alias("idle_s"))


#: Fixed value: the subcommands with what they tell.
OBJECT_HELP = (("ENCODING", "how a value is held"), ("FREQ", "the access frequency counter"), ("IDLETIME", "seconds since the last access"), ("REFCOUNT", "references of a value"), ("HELP", "this text"))


def object_help() -> list[str]:
    return [line for name, text in OBJECT_HELP for line in (f"{name}{'' if name == 'HELP' else ' <key>'}", f"    {text}")]


def object_freq(counters: DataFrame, policy: str = "allkeys-lfu") -> DataFrame:
    """The stored 8-bit counter of (key, freq); it is kept under a policy by frequency only."""
    if not policy.endswith("lfu"):
        raise ValueError("An LFU maxmemory policy is not selected, access frequency not tracked.")
    return counters.select("key", F.col("freq").bitwiseAND(255).alias("freq"))


def placement(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("slot", scalars.slot(F.col("key"))).withColumn("shard", F.col("slot").bitwiseAND(shards - 1))


def info_keyspace(k: DataFrame, now_ms: int) -> DataFrame:
    """By database: keys, keys with a deadline, and their mean time left (of what is not yet past it)."""
    rest = F.when(F.col("expire_at_ms") > now_ms, F.col("expire_at_ms") - now_ms)
    return k.groupBy("db").agg(F.count("*").alias("keys"), F.count("expire_at_ms").alias("expires"), F.coalesce(F.floor(F.sum(rest) / F.count(rest)), F.lit(0)).cast("long").alias("avg_ttl_ms"))


def touch(k: DataFrame, keys: DataFrame, now_ms: int, db: int = 0) -> DataFrame:
    """The keyspace with the access time of the probed live keys set."""
    hit = keys.select("key").distinct().withColumn("hit", F.lit(True))
    alive = F.col("expire_at_ms").isNull() | (F.col("expire_at_ms") > now_ms)
    return k.join(hit, "key", "left").withColumn("access_ms", F.when(F.col("hit") & alive & (F.col("db") == db), now_ms).otherwise(F.col("access_ms"))).select(*k.columns)


def touched(k: DataFrame, keys: DataFrame, now_ms: int, db: int = 0) -> DataFrame:
    """How many of the probed keys are live; repeats count."""
    return exists(k, keys, now_ms, db)


def command_shards(commands: DataFrame, shards: int) -> DataFrame:
    """(id, shards) of commands (id, keys): the different shards that their keys live in, ascending, which is the order to lock them in and the partitions to read."""
    keys = commands.select("id", F.explode_outer("keys").alias("key"))
    return keys.withColumn("shard", F.when(F.col("key").isNotNull(), scalars.shard(F.col("key"), shards))).groupBy("id").agg(F.array_sort(F.collect_set("shard")).alias("shards"))


def shard_filter(k: DataFrame, keys: list[str], shards: int) -> DataFrame:
    """Rows of a table with a ``shard`` column in the shards of these keys: literals, so that a table partitioned by shard reads those partitions only."""
    return k.filter(F.col("shard").isin(sorted({scalars.shard_of(key, shards) for key in keys})))


def latest(rows: DataFrame, *by: str, order: str = "ordinal") -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
