"""Operators that give a new keyspace: each takes the table and a batch of commands on one database; rows of other databases stay.

Several commands on one key count in the order of ``ordinal``. Commands that concern two keys (rename, copy, move) are all judged by the table before the batch: of those with one source the first counts, of
those with one target the last (the first, where the target must be free). Rows past their deadline are gone from every result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.keys import latest, live

COLUMNS = ("db", "key", "type", "val", "expire_at_ms", "access_ms")


def _mine(k: DataFrame, now_ms: int, db: int) -> tuple[DataFrame, DataFrame]:
    """Live rows of the database, and of the others."""
    here = live(k, now_ms)
    return here.filter(F.col("db") == db), here.filter(F.col("db") != db)


def set_keys(
    k: DataFrame, batch: DataFrame, now_ms: int, *, only: str | None = None, get: bool = False, keep_ttl: bool = False, deadline: Column | None = None, db: int = 0,
) -> DataFrame:
    """(keyspace columns, old_val, applied) for every key of the keyspace and of ``batch`` (ordinal, key, val).

    ``only``: ``NX`` sets absent keys (the first of several commands wins), ``XX`` present ones. ``get`` sets no key of another type (``applied`` is false there). ``deadline`` is over the batch's columns;
    without one, and without ``keep_ttl``, a set key does not expire. Deadlines in the past are stored as they are (before 0 as 0). The old value of a key of another type is null.
    A batch smaller than the broadcast threshold shuffles no row of the keyspace.
    """
    if only not in (None, "NX", "XX"):
        raise ValueError("only: NX or XX")
    if keep_ttl and deadline is not None:
        raise ValueError("a deadline and keep_ttl exclude each other")
    at = F.greatest(deadline, F.lit(0)) if deadline is not None else F.lit(None).cast("long")
    order = batch.withColumn("ordinal", -F.col("ordinal")) if only == "NX" else batch
    new = latest(order, "key").select("key", F.col("val").alias("new_val"), at.alias("new_at"), F.lit(True).alias("asked"))
    old, others = _mine(k, now_ms, db)
    found = old.join(new, "key", "left")
    wrong = F.lit(get) & (F.col("type") != "string")
    applied = F.coalesce("asked", F.lit(False)) & ~wrong & F.lit(only != "NX")
    kept = F.col("expire_at_ms") if keep_ttl else F.lit(None).cast("long")
    found = found.select(
        "db", "key", F.when(applied, F.lit("string")).otherwise(F.col("type")).alias("type"), F.when(applied, F.col("new_val")).otherwise(F.col("val")).alias("val"),
        F.when(applied, F.coalesce("new_at", kept)).otherwise(F.col("expire_at_ms")).alias("expire_at_ms"), F.when(applied, F.lit(now_ms)).otherwise(F.col("access_ms")).alias("access_ms"),
        F.when(F.col("type") == "string", F.col("val")).alias("old_val"), applied.alias("applied"),
    )
    rest = others.select(*COLUMNS, F.when(F.col("type") == "string", F.col("val")).alias("old_val"), F.lit(False).alias("applied"))
    if only == "XX":
        return found.union(rest)
    fresh = new.join(old.select("key"), "key", "left_anti")
    fresh = fresh.select(F.lit(db).alias("db"), "key", F.lit("string").alias("type"), F.col("new_val").alias("val"), F.col("new_at").alias("expire_at_ms"), F.lit(now_ms).alias("access_ms"), F.lit(None).cast("string").alias("old_val"), F.lit(True).alias("applied"))
    return found.union(rest).union(fresh)


def mset(k: DataFrame, batch: DataFrame, now_ms: int, db: int = 0) -> DataFrame:
    return set_keys(k, batch, now_ms, db=db).select(*COLUMNS)


def delete(k: DataFrame, keys: DataFrame, now_ms: int, db: int = 0) -> tuple[DataFrame, DataFrame]:
    """The keyspace without the keys, and how many live ones went (a repeated key counts once)."""
    mine = keys.select("key").distinct()
    rest = k.join(mine.withColumn("db", F.lit(db)), ["db", "key"], "left_anti")
    return rest, live(k, now_ms).filter(F.col("db") == db).join(mine, "key", "left_semi").agg(F.count("*").alias("n"))


def persist(k: DataFrame, keys: DataFrame, now_ms: int, db: int = 0) -> DataFrame:
    """(key, reply, expire_at_ms) of the probed keys: 1 where there was a deadline."""
    rows = keys.select("key").distinct().join(live(k, now_ms).filter(F.col("db") == db), "key", "left")
    return rows.select("key", F.col("expire_at_ms").isNotNull().cast("int").alias("reply"), F.lit(None).cast("long").alias("expire_at_ms"))


def persisted(k: DataFrame, keys: DataFrame, now_ms: int, db: int = 0) -> DataFrame:
    """The keyspace after that."""
    mine, others = _mine(k, now_ms, db)
    hit = keys.select("key").distinct().withColumn("hit", F.lit(True))
    return mine.join(hit, "key", "left").withColumn("expire_at_ms", F.when(F.col("hit").isNull(), F.col("expire_at_ms"))).select(*k.columns).union(others)


def expire(k: DataFrame, batch: DataFrame, now_ms: int, *, condition: str | None = None, unit_ms: int = 1000, absolute: bool = False, db: int = 0) -> DataFrame:
    """(ordinal if the batch has it, key, reply, event, expire_at_ms) for each row of ``batch`` (key, amount), the deadline as the command leaves it.

    Conditions: NX no deadline yet, XX one already, GT later, LT earlier; no deadline counts as never, so GT never applies to it and LT always does.
    A new deadline at or before the moment deletes the key (reply 1, event ``del``), and later commands find none. An amount that leaves 64 bits has a null reply and changes nothing.
    Commands on one key take effect one after another: what each finds follows from running extremes of the deadlines before it, so no list of commands is gathered.
    """
    ordered = "ordinal" in batch.columns
    rows = batch if ordered else batch.withColumn("ordinal", F.lit(0))
    rows = rows.join(live(k, now_ms).filter(F.col("db") == db).select("key", F.col("expire_at_ms").alias("old"), F.lit(True).alias("found")), "key", "left")
    at = F.try_multiply(F.col("amount"), F.lit(unit_ms).cast("long"))
    rows = rows.withColumn("new", at if absolute else F.try_add(at, F.lit(now_ms)))
    before = W.partitionBy("key").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    new, old, valid = F.col("new"), F.col("old"), F.col("new").isNotNull()
    if condition == "GT":  # the deadline so far is the latest of all; one in the past is never later
        now = F.greatest(old, F.max("new").over(before))
        allowed = old.isNotNull() & (new > now)
        now, dead = F.when(old.isNotNull(), now), F.lit(False)
    elif condition == "LT":
        now = F.least(old, F.min("new").over(before))
        dead = F.coalesce(F.min("new").over(before) <= now_ms, F.lit(False))
        allowed = now.isNull() | (new < now)
    else:
        takes = valid & {None: F.lit(True), "NX": old.isNull(), "XX": old.isNotNull()}[condition]
        dead = F.coalesce(F.max(takes & (new <= now_ms)).over(before), F.lit(False))
        if condition == "NX":  # only the first one can apply
            now = F.coalesce(old, F.first(new, ignorenulls=True).over(before))
            dead = F.coalesce(F.first(F.when(takes, new <= now_ms), ignorenulls=True).over(before), F.lit(False))
            allowed = now.isNull()
        else:
            now = F.coalesce(F.last(F.when(takes, new), ignorenulls=True).over(before), old)
            allowed = takes
    rows = rows.withColumn("now", now).withColumn("dead", dead).withColumn("ok", F.coalesce(allowed, F.lit(False)))
    rows = rows.withColumn("reply", F.when(~valid, None).otherwise((F.col("found").isNotNull() & ~F.col("dead") & F.col("ok")).cast("int")))
    gone = (F.col("reply") == 1) & (new <= now_ms)
    event = F.when(gone, "del").when(F.col("reply") == 1, "expire")
    left = F.when(F.col("found").isNull() | gone | F.col("dead"), None).when(F.col("reply") == 1, new).otherwise(F.col("now"))
    return rows.select(*(["ordinal"] if ordered else []), "key", "reply", event.alias("event"), left.alias("expire_at_ms"))


def expired_by(k: DataFrame, replies: DataFrame, now_ms: int, db: int = 0) -> DataFrame:
    """The keyspace after the commands that ``expire`` has answered (ordinal, key, reply, event, expire_at_ms)."""
    done = replies.filter("reply = 1").groupBy("key").agg(F.max_by(F.struct("event", "expire_at_ms"), "ordinal").alias("last"))
    mine, others = _mine(k, now_ms, db)
    rows = mine.join(done, "key", "left").filter("last IS NULL OR last.event <> 'del'")
    return rows.withColumn("expire_at_ms", F.when(F.col("last").isNull(), F.col("expire_at_ms")).otherwise(F.col("last.expire_at_ms"))).select(*k.columns).union(others)


def _moves(pairs: DataFrame, names: DataFrame, only_new: bool) -> DataFrame:
    """(src, dst, wins) of the (ordinal, src, dst) whose source is live, first by source; ``wins`` marks the one that the target goes to."""
    rows = pairs if "ordinal" in pairs.columns else pairs.withColumn("ordinal", F.lit(0))
    rows = rows.filter("src <> dst").join(names.withColumnRenamed("key", "src"), "src", "left_semi")
    if only_new:
        rows = rows.join(names.withColumnRenamed("key", "dst"), "dst", "left_anti")
    rows = rows.groupBy("src").agg(F.min(F.struct("ordinal", "dst")).alias("m")).select("src", "m.dst", "m.ordinal")
    best = W.partitionBy("dst").orderBy(F.col("ordinal") if only_new else F.col("ordinal").desc(), "src")
    return rows.withColumn("wins", F.row_number().over(best) == 1).select("src", "dst", "wins")


def rename(k: DataFrame, pairs: DataFrame, now_ms: int, *, only_new: bool = False, db: int = 0) -> DataFrame:
    """The keyspace after each (src, dst) of ``pairs`` moved its whole entry.

    A missing source changes nothing (``rename_replies`` has the error); a source renamed to itself stays. ``only_new`` leaves sources alone whose target is live or taken by an earlier command.
    """
    mine, others = _mine(k, now_ms, db)
    moves = _moves(pairs, mine.select("key"), only_new)
    if only_new:
        moves = moves.filter("wins")
    gone = moves.select(F.explode(F.array("src", "dst")).alias("key")).distinct()
    stay = mine.join(gone, "key", "left_anti").select(*k.columns)
    moved = mine.join(moves.filter("wins").select(F.col("src").alias("key"), "dst"), "key").withColumn("key", F.col("dst")).select(*k.columns)
    return others.union(stay).union(moved)


def rename_replies(k: DataFrame, pairs: DataFrame, now_ms: int, *, only_new: bool = False, db: int = 0) -> DataFrame:
    """(src, dst, reply, error) of each pair by itself: 1 where it applies; ``no such key`` without a live source."""
    names = live(k, now_ms).filter(F.col("db") == db).select("key", F.lit(True).alias("there"))
    rows = pairs.select("src", "dst").join(names.select(F.col("key").alias("src"), F.col("there").alias("has_src")), "src", "left").join(names.select(F.col("key").alias("dst"), F.col("there").alias("has_dst")), "dst", "left")
    missing = F.col("has_src").isNull()
    free = F.lit(not only_new) | (F.col("has_dst").isNull() & (F.col("src") != F.col("dst")))
    return rows.select("src", "dst", F.when(~missing, free.cast("int")).alias("reply"), F.when(missing, "no such key").alias("error"))


def copy(k: DataFrame, pairs: DataFrame, now_ms: int, *, to_db: int, replace: bool = False, db: int = 0) -> DataFrame:
    """The keyspace with a copy of each live string (src) as (dst) in ``to_db``: deadline kept, access time fresh. A key is not copied to itself, and only strings are."""
    here = live(k, now_ms)
    rows = pairs if "ordinal" in pairs.columns else pairs.withColumn("ordinal", F.lit(0))
    rows = rows if to_db != db else rows.filter("src <> dst")
    target = here.filter(F.col("db") == to_db).select(F.col("key").alias("dst"))
    rows = rows.join(here.filter((F.col("db") == db) & (F.col("type") == "string")).withColumnRenamed("key", "src"), "src")
    if not replace:
        rows = rows.join(target, "dst", "left_anti")
    order = W.partitionBy("dst").orderBy(F.col("ordinal").desc() if replace else F.col("ordinal"), "src")
    copies = rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(F.lit(to_db).alias("db"), F.col("dst").alias("key"), "type", "val", "expire_at_ms", F.lit(now_ms).alias("access_ms"))
    if replace:
        here = here.join(copies.select("db", "key"), ["db", "key"], "left_anti")
    return here.select(*COLUMNS).union(copies)


def move(k: DataFrame, keys: DataFrame, now_ms: int, *, to_db: int, db: int = 0) -> DataFrame:
    """The keyspace after the keys went to another database, where it has none of that name; entries are kept whole."""
    if to_db == db:
        raise ValueError("source and target are one database")
    here = live(k, now_ms)
    free = keys.select("key").distinct().join(here.filter(F.col("db") == to_db), "key", "left_anti").withColumn("go", F.lit(True))
    return here.join(free, "key", "left").withColumn("db", F.when(F.col("go") & (F.col("db") == db), to_db).otherwise(F.col("db"))).select(*k.columns)


def move_events(k: DataFrame, keys: DataFrame, now_ms: int, *, to_db: int, db: int = 0) -> DataFrame:
    """(db, key, event) of the same moves: ``move_from`` in the one database and ``move_to`` in the other."""
    here = live(k, now_ms)
    went = keys.select("key").distinct().join(here.filter(F.col("db") == db), "key", "left_semi").join(here.filter(F.col("db") == to_db), "key", "left_anti")
    return went.select(F.inline(F.array(*(F.struct(F.lit(d).alias("db"), F.col("key"), F.lit(e).alias("event")) for d, e in ((db, "move_from"), (to_db, "move_to"))))))


def flush(k: DataFrame, db: int | None = None) -> DataFrame:
    """Without one database, or without any rows."""
    return k.filter(F.lit(False)) if db is None else k.filter(F.col("db") != db)


def fold(log: DataFrame) -> DataFrame:
    """The keyspace that a log of SET, PERSIST and DEL (seq, key, cmd, val, expire_at_ms) leaves, without a loop.

    The last SET or DEL of a key decides whether it is there and with what; a later PERSIST takes its deadline.
    """
    whole = F.when(F.col("cmd") != "PERSIST", F.col("seq"))
    rows = log.groupBy("key").agg(F.max(whole).alias("at"), F.max_by(F.struct("cmd", "val", "expire_at_ms"), whole).alias("last"), F.max(F.when(F.col("cmd") == "PERSIST", F.col("seq"))).alias("kept"))
    rows = rows.filter("last.cmd = 'SET'")
    return rows.select("key", F.col("last.val").alias("val"), F.when(F.coalesce(F.col("kept") > F.col("at"), F.lit(False)), None).otherwise(F.col("last.expire_at_ms")).alias("expire_at_ms"))


#: The letters of event classes, and those that A stands for.
CLASSES = {"generic": "g", "string": "$", "list": "l", "set": "s", "hash": "h", "zset": "z", "expired": "x", "evicted": "e", "stream": "t", "module": "d", "new": "n", "miss": "m"}
ALL_CLASSES = "g$lshzxetd"


def notifications(changes: DataFrame, flags: str = "KEA") -> DataFrame:
    """(channel, message) of changes (db, key, event[, class]): one on the key's channel (flag K), one on the event's (flag E).

    Classes are named by their letters, ``A`` stands for all but ``n`` and ``m``. Changes without a class column are of any class.
    """
    letters = set(flags.replace("A", ALL_CLASSES))
    if unknown := letters - {"K", "E", *CLASSES.values()}:
        raise ValueError(f"no such class: {''.join(sorted(unknown))}")
    if "class" in changes.columns:
        changes = changes.filter(F.col("class").isin([name for name, letter in CLASSES.items() if letter in letters]))
    where = lambda kind, name: F.concat(F.lit(f"__{kind}@"), F.col("db").cast("string"), F.lit("__:"), F.col(name))
    both = {"K": F.struct(where("keyspace", "key").alias("channel"), F.col("event").alias("message")), "E": F.struct(where("keyevent", "event").alias("channel"), F.col("key").alias("message"))}
    wanted = [both[c] for c in "KE" if c in letters]
    pair = F.explode(F.array(*(wanted or both.values())))
    return (changes if wanted else changes.filter(F.lit(False))).select(pair.alias("n")).select("n.*")


def propagation(applied: DataFrame, now_ms: int) -> DataFrame:
    """(key, argv) of the deterministic commands that repeat deadline changes (key, reply, event, expire_at_ms): absolute times, deletions as such, no-ops left out."""
    argv = F.when(F.col("event") == "del", F.array(F.lit("DEL"), F.col("key"))).otherwise(F.array(F.lit("PEXPIREAT"), F.col("key"), F.col("expire_at_ms").cast("string")))
    return applied.filter("reply = 1").select("key", F.array_join(argv, " ").alias("argv"))


def propagate_set(batch: DataFrame, shards: int) -> DataFrame:
    """(shard, seq, key, argv) of SET commands (ordinal, key, val, expire_at_ms): the deadline as ``PXAT``; numbered within the shard that owns the key, in the order of the batch."""
    from tessera.functions.scalars import shard

    argv = F.concat(F.array(F.lit("SET"), F.col("key"), F.col("val")), F.when(F.col("expire_at_ms").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lit("PXAT"), F.col("expire_at_ms").cast("string"))))
    return _numbered(batch.select(shard(F.col("key"), shards).alias("shard"), "ordinal", "key", F.array_join(argv, " ").alias("argv")))


def propagate_restore(batch: DataFrame, shards: int) -> DataFrame:
    """The same of RESTORE commands (ordinal, key, payload, expire_at_ms): the time as a deadline with ``ABSTTL``, 0 for none; payloads in base 16."""
    from tessera.functions.scalars import shard

    argv = F.array(F.lit("RESTORE"), F.col("key"), F.coalesce("expire_at_ms", F.lit(0)).cast("string"), F.hex("payload"), F.lit("ABSTTL"))
    return _numbered(batch.select(shard(F.col("key"), shards).alias("shard"), "ordinal", "key", F.array_join(argv, " ").alias("argv")))


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("seq", (F.row_number().over(W.partitionBy("shard").orderBy("ordinal")) - 1).cast("long")).select("shard", "seq", "key", "argv")
