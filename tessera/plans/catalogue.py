"""Queries over the keyspace, and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import codecs, scalars
from tessera.operators import collections as C
from tessera.operators import extras, keys, memory, server, writes
from tessera.sources import fixtures as X
from tessera.sources.fixtures import DAY_MS, NOW_MS

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

#: The fixtures in DuckDB's words.
_KS = f"""ks AS (SELECT 0 AS db, 'event:' || event_id AS key, 'string' AS type, value::DECIMAL(18,2)::VARCHAR AS val,
  CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts)//1000 + event_id % 20 * {DAY_MS} END AS expire_at_ms, epoch_us(ts)//1000 AS access_ms FROM events),
live AS (SELECT * FROM ks WHERE expire_at_ms IS NULL OR expire_at_ms > {NOW_MS})"""
_SV = "sv AS (SELECT 'num:' || c_custkey AS key, c_custkey::VARCHAR AS val FROM customer UNION ALL SELECT 'name:' || c_custkey, c_name FROM customer UNION ALL SELECT 'doc:' || doc_id, text FROM documents)"
_Z = "z AS (SELECT 'cust:' || o_custkey AS key, 'order:' || o_orderkey AS member, o_totalprice AS score FROM orders)"
_ZT = "z AS (SELECT 'cust:' || o_custkey AS key, 'order:' || o_orderkey AS member, substr(o_orderpriority, 1, 1)::DOUBLE AS score FROM orders)"
_L = "l AS (SELECT 'user:' || user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, event_type AS elem FROM events)"
_S = "s AS (SELECT DISTINCT 'supp:' || l_suppkey AS key, l_partkey AS member FROM lineitem)"
_H = "h AS (SELECT 'part:' || p_partkey AS key, unnest(['brand', 'type', 'size']) AS field, unnest([p_brand, p_type, p_size::VARCHAR]) AS value FROM part)"
_ST = "st AS (SELECT ms, row_number() OVER (PARTITION BY ms ORDER BY event_id) - 1 AS seq, event_type, user_id FROM (SELECT *, epoch_us(ts)//1000 AS ms FROM events))"
_MU = f"""mu AS (SELECT event_id AS seq, 'user:' || user_id AS key, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'SET' WHEN event_type = 'signup' THEN 'PERSIST' ELSE 'DEL' END AS cmd,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_id::VARCHAR END AS val, CASE WHEN event_type = 'purchase' THEN epoch_us(ts)//1000 + {DAY_MS} END AS expire_at_ms FROM events)"""
_WK = f"""wk AS (SELECT (event_id % 3)::INT AS db, 'k:' || (event_id // 3) AS key, CASE WHEN event_id % 2 = 0 THEN 'string' ELSE ['string', 'list', 'hash', 'set', 'zset', 'stream'][(event_id // 7 % 6 + 1)::INT] END AS type,
  CASE WHEN event_id % 2 = 0 OR event_id // 7 % 6 = 0 THEN value::DECIMAL(18,2)::VARCHAR END AS val,
  CASE WHEN event_id % 4 <> 0 THEN epoch_us(ts)//1000 + event_id % 20 * {DAY_MS} END AS expire_at_ms, epoch_us(ts)//1000 AS access_ms, (event_id * 7 % 256)::INT AS freq FROM events),
wl AS (SELECT * FROM wk WHERE expire_at_ms IS NULL OR expire_at_ms > {NOW_MS})"""
#: Commands on that table, one for each order: repeated keys, missing keys, keys past their deadline.
_WB = "wb AS (SELECT o_orderkey AS ordinal, 'k:' || (o_orderkey // 4) AS key, 'v' || o_orderkey AS val FROM orders)"
#: Probed keys, one for each order: some live, some past their deadline, some missing, each twice.
_PR = "pr AS (SELECT o_orderkey AS ordinal, 'event:' || (o_orderkey - o_orderkey % 2) AS key FROM orders)"

_CRC = "list_reduce(list_prepend(0, list_transform(range(1, strlen(t) + 1), lambda i: ('0x' || substr(hex(encode(t)), (2 * i - 1)::INT, 2))::INT)), lambda c, o: list_reduce(list_prepend(xor(c, o << 8), range(8)::INT[]), lambda x, y: CASE WHEN x & 32768 <> 0 THEN xor((x << 1) & 65535, 4129) ELSE (x << 1) & 65535 END))"
_TAG = "coalesce(nullif(regexp_extract(key, '^[^{]*\\{([^}]+)\\}', 1), ''), key)"


def _slots(rows: str) -> str:
    return f"(SELECT *, ({_CRC}) & 16383 AS slot FROM (SELECT *, {_TAG} AS t FROM {rows}))"


def query(oracle: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if oracle is not None:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def _probes(spark, d) -> DataFrame:
    key = F.concat(F.lit("event:"), (F.col("o_orderkey") - F.col("o_orderkey") % 2).cast("string"))
    return X.table(spark, d, "orders").select(F.col("o_orderkey").alias("ordinal"), key.alias("key"))


def _commands(spark, d) -> DataFrame:
    i = F.col("o_orderkey")
    return X.table(spark, d, "orders").select(i.alias("ordinal"), F.concat(F.lit("k:"), F.floor(i / 4).cast("string")).alias("key"), F.concat(F.lit("v"), i.cast("string")).alias("val"))


def _keys(spark, d) -> DataFrame:
    return _probes(spark, d).select("key").distinct()


_DP = "dp AS (SELECT DISTINCT key FROM pr)"


@query(f"WITH {_KS}, p AS (SELECT 'event:' || unnest([1, 2, 3, 40, 99, 123456789]) AS key) SELECT p.key, live.val, false AS wrong_type FROM p LEFT JOIN live USING (key)")
def get_point(spark, d):
    wanted = spark.createDataFrame([(f"event:{i}",) for i in (1, 2, 3, 40, 99, 123456789)], "key string")
    return keys.get(X.keyspace(spark, d), wanted, NOW_MS)


@query(f"WITH {_KS}, {_PR} SELECT ordinal, pr.key, val FROM pr LEFT JOIN live USING (key)")
def mget_probe(spark, d):
    return keys.mget(X.keyspace(spark, d), _probes(spark, d), NOW_MS)


@query(f"WITH {_SV} SELECT key, octet_length(encode(val))::BIGINT AS n_bytes FROM sv")
def strlen_values(spark, d):
    return keys.strlen(X.string_values(spark, d))


@query(f"WITH {_KS}, {_PR} SELECT count(*) AS n FROM pr JOIN live USING (key)")
def exists_repeats(spark, d):
    return keys.exists(X.keyspace(spark, d), _probes(spark, d), NOW_MS)


@query(f"WITH {_KS}, {_PR}, {_DP} SELECT dp.key, coalesce(type, 'none') AS type FROM dp LEFT JOIN live USING (key)")
def type_lookup(spark, d):
    return keys.type_of(X.keyspace(spark, d), _keys(spark, d), NOW_MS)


@query(f"""WITH {_KS}, {_PR}, {_DP} SELECT dp.key, CASE WHEN type IS NULL THEN -2 WHEN expire_at_ms IS NULL THEN -1 ELSE (expire_at_ms - {NOW_MS} + 500) // 1000 END::BIGINT AS ttl,
  CASE WHEN type IS NULL THEN -2 WHEN expire_at_ms IS NULL THEN -1 ELSE expire_at_ms - {NOW_MS} END::BIGINT AS pttl FROM dp LEFT JOIN live USING (key)""")
def ttl_pttl(spark, d):
    return keys.ttl(X.keyspace(spark, d), _keys(spark, d), NOW_MS)


@query(f"""WITH {_KS}, {_PR}, {_DP} SELECT dp.key, CASE WHEN type IS NULL THEN -2 WHEN expire_at_ms IS NULL THEN -1 ELSE (expire_at_ms + 500) // 1000 END::BIGINT AS expiretime,
  CASE WHEN type IS NULL THEN -2 WHEN expire_at_ms IS NULL THEN -1 ELSE expire_at_ms END::BIGINT AS pexpiretime FROM dp LEFT JOIN live USING (key)""")
def expiretime(spark, d):
    return keys.expiretime(X.keyspace(spark, d), _keys(spark, d), NOW_MS)


@query(f"WITH {_KS}, {_PR}, {_DP} SELECT dp.key, (expire_at_ms IS NOT NULL)::INT AS reply, NULL::BIGINT AS expire_at_ms FROM dp LEFT JOIN live USING (key)")
def persist(spark, d):
    return writes.persist(X.keyspace(spark, d), _keys(spark, d), NOW_MS)


def _expire(condition, test, unit=1000, absolute=False):
    amount = "len(key) * 86400 - 900000" if not absolute else f"{NOW_MS // 1000} + len(key) * 86400 - 900000"
    new = f"(({amount}) * {unit}" + ("" if absolute else f" + {NOW_MS}") + ")"
    return f"""WITH {_KS}, {_PR}, {_DP}, r AS (SELECT dp.key, type, expire_at_ms AS old, {new}::BIGINT AS new FROM dp LEFT JOIN live USING (key)),
      q AS (SELECT *, (type IS NOT NULL AND ({test}))::INT AS reply FROM r)
      SELECT key, reply, CASE WHEN reply = 1 AND new <= {NOW_MS} THEN 'del' WHEN reply = 1 THEN 'expire' END AS event,
        CASE WHEN reply = 1 AND new <= {NOW_MS} THEN NULL WHEN reply = 1 THEN new ELSE old END AS expire_at_ms FROM q"""


def _amounts(spark, d, absolute=False) -> DataFrame:
    amount = (F.length("key") * 86400 - 900000).cast("long")
    return _keys(spark, d).withColumn("amount", amount + NOW_MS // 1000 if absolute else amount)


@query(_expire(None, "true"))
def expire_plain(spark, d):
    return writes.expire(X.keyspace(spark, d), _amounts(spark, d), NOW_MS)


@query(_expire("NX", "old IS NULL"))
def expire_nx(spark, d):
    return writes.expire(X.keyspace(spark, d), _amounts(spark, d), NOW_MS, condition="NX")


@query(_expire("XX", "old IS NOT NULL"))
def expire_xx(spark, d):
    return writes.expire(X.keyspace(spark, d), _amounts(spark, d), NOW_MS, condition="XX")


@query(_expire("GT", "old IS NOT NULL AND new > old"))
def expire_gt(spark, d):
    return writes.expire(X.keyspace(spark, d), _amounts(spark, d), NOW_MS, condition="GT")


@query(_expire("LT", "old IS NULL OR new < old"))
def expire_lt(spark, d):
    return writes.expire(X.keyspace(spark, d), _amounts(spark, d), NOW_MS, condition="LT")


@query(_expire(None, "true", unit=1))
def pexpire(spark, d):
    return writes.expire(X.keyspace(spark, d), _amounts(spark, d), NOW_MS, unit_ms=1)


@query(_expire(None, "true", absolute=True))
def expireat(spark, d):
    return writes.expire(X.keyspace(spark, d), _amounts(spark, d, True), NOW_MS, absolute=True)


@query(f"WITH e AS ({_expire(None, 'true')}) SELECT key, CASE WHEN event = 'del' THEN 'DEL ' || key ELSE 'PEXPIREAT ' || key || ' ' || expire_at_ms END AS argv FROM e WHERE reply = 1")
def propagation(spark, d):
    return writes.propagation(writes.expire(X.keyspace(spark, d), _amounts(spark, d), NOW_MS), NOW_MS)


#: Each event's key goes to another name; some names exist, some are shared by three sources.
_PAIRS = "pairs AS (SELECT event_id AS ordinal, 'event:' || event_id AS src, CASE WHEN event_id % 5 = 0 THEN 'event:' || (event_id + 1) ELSE 'new:' || (event_id // 3) END AS dst FROM events)"


def _pairs(spark, d) -> DataFrame:
    i = F.col("event_id")
    dst = F.when(i % 5 == 0, F.concat(F.lit("event:"), (i + 1).cast("string"))).otherwise(F.concat(F.lit("new:"), F.floor(i / 3).cast("string")))
    return X.table(spark, d, "events").select(i.alias("ordinal"), F.concat(F.lit("event:"), i.cast("string")).alias("src"), dst.alias("dst"))


def _renamed(free: str) -> str:
    order, moved = ("ASC", "WHERE n = 1") if free else ("DESC", "")
    return f"""WITH {_KS}, {_PAIRS}, m AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY ordinal {order}) AS n FROM pairs WHERE src IN (SELECT key FROM live) {free}), went AS (SELECT * FROM m {moved})
      SELECT * FROM live WHERE key NOT IN (SELECT src FROM went UNION ALL SELECT dst FROM went)
      UNION ALL SELECT db, dst, type, val, expire_at_ms, access_ms FROM live JOIN went ON key = src WHERE n = 1"""


@query(_renamed(""))
def rename_overwrite(spark, d):
    return writes.rename(X.keyspace(spark, d), _pairs(spark, d), NOW_MS)


@query(_renamed("AND dst NOT IN (SELECT key FROM live)"))
def renamenx(spark, d):
    return writes.rename(X.keyspace(spark, d), _pairs(spark, d), NOW_MS, only_new=True)


@query(f"""WITH {_KS}, {_PAIRS}, c AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY ordinal) AS n FROM live JOIN pairs ON key = src)
  SELECT * FROM live UNION ALL SELECT 1, dst, type, val, expire_at_ms, {NOW_MS} FROM c WHERE n = 1""")
def copy_db(spark, d):
    return writes.copy(X.keyspace(spark, d), _pairs(spark, d), NOW_MS, to_db=1)


@query(f"""WITH {_KS}, {_PAIRS}, c AS (SELECT dst AS key, type, val, expire_at_ms FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY ordinal DESC) AS n FROM live JOIN pairs ON key = src) WHERE n = 1)
  SELECT * FROM live WHERE key NOT IN (SELECT key FROM c) UNION ALL SELECT 0, key, type, val, expire_at_ms, {NOW_MS} FROM c""")
def copy_replace(spark, d):
    return writes.copy(X.keyspace(spark, d), _pairs(spark, d), NOW_MS, to_db=0, replace=True)


@query(f"WITH {_KS}, {_PR} SELECT CASE WHEN key IN (SELECT key FROM pr) THEN 3 ELSE 0 END AS db, key, type, val, expire_at_ms, access_ms FROM live")
def move_db(spark, d):
    return writes.move(X.keyspace(spark, d), _keys(spark, d), NOW_MS, to_db=3)


@query(f"WITH {_KS} SELECT key, CASE WHEN expire_at_ms IS NULL THEN -1 ELSE expire_at_ms - {NOW_MS} END::BIGINT AS pttl FROM live WHERE regexp_full_match(key, 'event:1.*[^5-9]')")
def keys_glob(spark, d):
    rows = keys.match_keys(X.keyspace(spark, d), "event:1*[^5-9]", NOW_MS)
    return rows.select("key", F.coalesce(F.col("expire_at_ms") - NOW_MS, F.lit(-1)).alias("pttl"))


@query(f"WITH {_KS} SELECT key, val FROM live WHERE key LIKE 'event:77%'")
def keys_prefix(spark, d):
    return keys.match_keys(X.keyspace(spark, d), "event:77*", NOW_MS).select("key", "val")


@query(f"WITH {_KS} SELECT arg_min(key, md5('s1' || key)) AS key FROM live")
def randomkey(spark, d):
    return keys.random_key(X.keyspace(spark, d), NOW_MS, "s1")


@query(f"""WITH {_KS}, q AS (SELECT key, slot & 7 AS shard, (slot >> 3) & 255 AS bucket FROM {_slots('live')})
  SELECT key, shard, bucket, ((list_reduce(list_prepend(0, range(8)::INT[]), lambda a, i: a | (((bucket >> i) & 1) << (7 - i)))::BIGINT << 3) | shard)::BIGINT AS "cursor" FROM q WHERE shard = 5""")
def scan_bucket(spark, d):
    return keys.scan(X.keyspace(spark, d), NOW_MS, shards=8, bits=8, shard=5)


@query(f"WITH {_KS} SELECT count(*) AS n FROM ks")
def dbsize_raw(spark, d):
    return keys.dbsize(X.keyspace(spark, d))


@query(f"""WITH {_KS} SELECT db, count(*) AS keys, count(expire_at_ms) AS expires,
  coalesce((sum(expire_at_ms - {NOW_MS}) FILTER (expire_at_ms > {NOW_MS}))::BIGINT // count(*) FILTER (expire_at_ms > {NOW_MS}), 0)::BIGINT AS avg_ttl_ms FROM ks GROUP BY db""")
def info_keyspace(spark, d):
    return keys.info_keyspace(X.keyspace(spark, d), NOW_MS)


_INTLIKE = "octet_length(encode(val)) <= 20 AND regexp_full_match(val, '0|-?[1-9][0-9]*') AND try_cast(val AS BIGINT) IS NOT NULL"


@query(f"WITH {_SV} SELECT key, CASE WHEN {_INTLIKE} THEN 'int' WHEN octet_length(encode(val)) <= 44 THEN 'embstr' ELSE 'raw' END AS encoding FROM sv")
def object_encoding(spark, d):
    return X.string_values(spark, d).select("key", scalars.encoding(F.col("val")).alias("encoding"))


@query(f"""WITH {_KS} SELECT key, CASE WHEN octet_length(encode(val)) <= 44 THEN 'embstr' ELSE 'raw' END AS encoding, 1 AS refcount,
  ((({NOW_MS} // 1000 - access_ms // 1000) % 16777216 + 16777216) % 16777216)::BIGINT AS idle_s FROM live""")
def object_idletime(spark, d):
    return keys.object_info(X.keyspace(spark, d), NOW_MS)


@query("SELECT 'event:' || event_id AS key, (event_id % 300 & 255)::BIGINT AS freq FROM events")
def object_freq(spark, d):
    return keys.object_freq(X.table(spark, d, "events").select(F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("key"), (F.col("event_id") % 300).alias("freq")))


@query("WITH tk AS (SELECT '{user:' || user_id || '}:' || event_id AS key FROM events) SELECT key, slot, slot & 7 AS shard FROM " + _slots("tk"))
def slot_placement(spark, d):
    return keys.placement(X.tagged_keys(spark, d), 8)


@query(f"WITH {_KS} SELECT slot & 15 AS shard, count(*) AS n FROM {_slots('ks')} GROUP BY 1")
def shard_histogram(spark, d):
    return keys.placement(X.keyspace(spark, d), 16).groupBy("shard").agg(F.count("*").alias("n"))


#: A command for each order, three on each key; some keys are new.
_BATCH = "b AS (SELECT o_orderkey AS ordinal, 'event:' || (o_orderkey // 3 * 2) AS key, 'v' || o_orderkey AS val FROM orders)"


def _batch(spark, d) -> DataFrame:
    i = F.col("o_orderkey")
    return X.table(spark, d, "orders").select(i.alias("ordinal"), F.concat(F.lit("event:"), (F.floor(i / 3) * 2).cast("string")).alias("key"), F.concat(F.lit("v"), i.cast("string")).alias("val"))


def _set(pick: str, applied: str, at: str = "NULL") -> str:
    return f"""WITH {_KS}, {_BATCH}, n AS (SELECT key, arg_{pick}(val, ordinal) AS nv FROM b GROUP BY key),
      j AS (SELECT coalesce(live.key, n.key) AS key, type, val, expire_at_ms, access_ms, nv, coalesce(nv IS NOT NULL AND ({applied}), false) AS applied FROM live FULL JOIN n ON live.key = n.key)
      SELECT 0 AS db, key, 'string' AS type, CASE WHEN applied THEN nv ELSE val END AS val, CASE WHEN applied THEN {at} ELSE expire_at_ms END::BIGINT AS expire_at_ms,
        CASE WHEN applied THEN {NOW_MS} ELSE access_ms END::BIGINT AS access_ms, val AS old_val, applied FROM j WHERE type IS NOT NULL OR applied"""


@query(_set("max", "true"))
def set_get(spark, d):
    return writes.set_keys(X.keyspace(spark, d), _batch(spark, d), NOW_MS)


@query(_set("min", "type IS NULL"))
def set_nx(spark, d):
    return writes.set_keys(X.keyspace(spark, d), _batch(spark, d), NOW_MS, only="NX")


@query(_set("max", "type IS NOT NULL"))
def set_xx(spark, d):
    return writes.set_keys(X.keyspace(spark, d), _batch(spark, d), NOW_MS, only="XX")


@query(_set("max", "true", "expire_at_ms"))
def set_keepttl(spark, d):
    return writes.set_keys(X.keyspace(spark, d), _batch(spark, d), NOW_MS, keep_ttl=True)


@query(_set("max", "true", f"{NOW_MS} + 60000"))
def set_px(spark, d):
    return writes.set_keys(X.keyspace(spark, d), _batch(spark, d), NOW_MS, deadline=F.lit(NOW_MS + 60000).cast("long"))


@query(f"SELECT db, key, type, val, expire_at_ms, access_ms FROM ({_set('max', 'true')})")
def mset_last_wins(spark, d):
    return writes.mset(X.keyspace(spark, d), _batch(spark, d), NOW_MS)


@query(f"WITH {_KS}, {_PR} SELECT count(DISTINCT live.key) AS n FROM live JOIN pr USING (key)")
def del_count(spark, d):
    return writes.delete(X.keyspace(spark, d), _probes(spark, d), NOW_MS)[1]


@query(f"WITH {_KS}, {_PR} SELECT db, key, type, val, expire_at_ms, access_ms FROM ks WHERE key NOT IN (SELECT key FROM pr)")
def unlink_rest(spark, d):
    return writes.delete(X.keyspace(spark, d), _probes(spark, d), NOW_MS)[0]


@query(f"WITH {_KS}, {_PR} SELECT db, key, type, val, expire_at_ms, CASE WHEN key IN (SELECT key FROM pr) AND (expire_at_ms IS NULL OR expire_at_ms > {NOW_MS}) THEN {NOW_MS} ELSE access_ms END::BIGINT AS access_ms FROM ks")
def touch(spark, d):
    return keys.touch(X.keyspace(spark, d), _probes(spark, d), NOW_MS)


@query(f"WITH {_WK} SELECT db, key FROM wk WHERE db <> 0")
def flushdb(spark, d):
    return writes.flush(X.wide_keyspace(spark, d), 0).select("db", "key")


@query(f"WITH {_WK}, f AS (SELECT 0 AS db, NULL AS key WHERE false) SELECT d.db, count(f.db) AS n FROM (SELECT DISTINCT db FROM wk) d LEFT JOIN f ON d.db = f.db GROUP BY d.db")
def flushall(spark, d):
    """Rows left in each database that there was."""
    rest = writes.flush(X.wide_keyspace(spark, d)).select(F.col("db").alias("r"))
    return X.wide_keyspace(spark, d).select("db").distinct().join(rest, F.col("db") == F.col("r"), "left").groupBy("db").agg(F.count("r").alias("n"))


# --- collections ---


@query(f"WITH {_Z} SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rev_rank FROM z")
def zset_rank(spark, d):
    return C.zset_rank(X.zset_members(spark, d))


@query(f"WITH {_ZT} SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rev_rank FROM z")
def zset_rank_ties(spark, d):
    return C.zset_rank(X.zset_members(spark, d, ties=True))


@query(f"WITH {_Z} SELECT * FROM z WHERE score > 1000 AND score <= 200000")
def zset_range_score(spark, d):
    return C.zset_range_score(X.zset_members(spark, d), 1000.0, 200000.0, low_open=True)


@query("SELECT c_name AS member FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#0000002'")
def zset_range_lex(spark, d):
    rows = X.table(spark, d, "customer").select(F.lit("names").alias("key"), F.col("c_name").alias("member"), F.lit(0.0).alias("score"))
    return C.zset_range_lex(rows, "Customer#000000100", "Customer#0000002", high_open=True).select("member")


@query(f"WITH {_Z} SELECT key, count(*) AS n FROM z WHERE score >= 100000 GROUP BY key")
def zset_count(spark, d):
    return C.zset_count(X.zset_members(spark, d), 100000.0, None)


@query(f"WITH {_Z}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS a, count(*) OVER (PARTITION BY key) AS n FROM z) SELECT key, member, score FROM r WHERE NOT (a >= 1 AND a <= n - 2)")
def zset_delete_by_rank(spark, d):
    return C.zset_delete_by_rank(X.zset_members(spark, d), 1, -2).select("key", "member", "score")


@query(f"WITH {_ZT}, n AS (SELECT key, 'order:new' AS member, max(score) + 1 AS score FROM z GROUP BY key) SELECT * FROM z UNION ALL SELECT * FROM n")
def zset_upsert(spark, d):
    z = X.zset_members(spark, d, ties=True)
    return C.zset_upsert(z, z.groupBy("key").agg(F.lit("order:new").alias("member"), (F.max("score") + 1).alias("score"))).select("key", "member", "score")


_ZU = "z AS (SELECT event_type AS key, user_id::VARCHAR AS member, count(*)::DOUBLE AS score FROM events GROUP BY ALL)"


def _activity(spark, d):
    return X.table(spark, d, "events").groupBy(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member")).agg(F.count("*").cast("double").alias("score"))


@query(f"WITH {_ZU} SELECT member, sum(score * CASE WHEN key = 'purchase' THEN 3 ELSE 1 END) AS score FROM z WHERE key IN ('view', 'purchase') GROUP BY member")
def zset_union(spark, d):
    return C.zset_combine(_activity(spark, d), ["view", "purchase"], weight={"purchase": 3.0})


@query(f"WITH {_ZU} SELECT member, max(score) AS score FROM z WHERE key IN ('view', 'error') GROUP BY member HAVING count(*) = 2")
def zset_inter(spark, d):
    return C.zset_combine(_activity(spark, d), ["view", "error"], "inter", aggregate="max")


@query(f"WITH {_L}, n AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM l) SELECT key, elem FROM n WHERE pos = n - 2")
def list_index(spark, d):
    return C.list_index(X.list_items(spark, d), -2)


@query(f"WITH {_L}, n AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM l) SELECT key, pos, elem FROM n WHERE pos >= 2 AND pos <= n - 3")
def list_range(spark, d):
    return C.list_range(X.list_items(spark, d), 2, -3)


def _removed(order: str, test: str) -> str:
    return f"WITH {_L}, n AS (SELECT *, row_number() OVER (PARTITION BY key, elem ORDER BY pos {order}) AS i FROM l) SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos, elem FROM n WHERE NOT (elem = 'click' AND ({test}))"


@query(_removed("ASC", "i <= 2"))
def list_remove_value(spark, d):
    return C.list_remove_value(X.list_items(spark, d), "click", 2).select("key", "pos", "elem")


@query(_removed("DESC", "i <= 3"))
def list_remove_back(spark, d):
    return C.list_remove_value(X.list_items(spark, d), "click", -3).select("key", "pos", "elem")


@query(f"""WITH {_L}, p AS (SELECT key, min(pos) AS p FROM l WHERE elem = 'error' GROUP BY key), u AS (SELECT key, pos::DOUBLE AS pos, elem FROM l UNION ALL SELECT key, p - 0.5, 'new' FROM p)
  SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos, elem FROM u""")
def list_insert(spark, d):
    return C.list_insert(X.list_items(spark, d), "error", "new")


@query(f"WITH {_L}, n AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM l) SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos, elem FROM n WHERE NOT (pos >= greatest(n - 5, 0) AND pos < greatest(n - 5, 0) + 3)")
def list_delete_range(spark, d):
    return C.list_delete_range(X.list_items(spark, d), -5, 3)


@query(f"WITH {_L} SELECT key, max(pos) AS pos FROM l WHERE elem = 'view' GROUP BY key")
def list_position(spark, d):
    return C.list_position(X.list_items(spark, d), "view", last=True)


@query(f"""WITH {_L}, u AS (SELECT key, pos, elem FROM l UNION ALL SELECT key, -i, 'head' || i FROM (SELECT DISTINCT key FROM l), range(1, 3) t(i))
  SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos, elem FROM u""")
def list_push(spark, d):
    rows = X.list_items(spark, d)
    items = rows.select("key").distinct().select("key", F.explode(F.array(F.lit(1), F.lit(2))).alias("ordinal")).withColumn("elem", F.concat(F.lit("head"), F.col("ordinal").cast("string")))
    return C.list_push(rows, items, front=True)


@query(f"WITH {_S} SELECT member FROM s WHERE key = 'supp:1' INTERSECT SELECT member FROM s WHERE key = 'supp:2'")
def set_inter(spark, d):
    return C.set_algebra(X.set_members(spark, d), ["supp:1", "supp:2"], "inter")


@query(f"WITH {_S} SELECT member FROM s WHERE key = 'supp:1' EXCEPT SELECT member FROM s WHERE key IN ('supp:2', 'supp:3')")
def set_diff(spark, d):
    return C.set_algebra(X.set_members(spark, d), ["supp:1", "supp:2", "supp:3"], "diff")


@query(f"WITH {_S} SELECT member FROM s WHERE key = 'supp:1' UNION SELECT member FROM s WHERE key = 'supp:2'")
def set_union(spark, d):
    return C.set_algebra(X.set_members(spark, d), ["supp:1", "supp:2"], "union")


@query(f"WITH {_S}, p AS (SELECT DISTINCT 'supp:' || (p_partkey % 10 + 1) AS key, p_partkey AS member FROM part) SELECT p.key, p.member, (s.key IS NOT NULL)::INT AS hit FROM p LEFT JOIN s ON s.key = p.key AND s.member = p.member")
def set_contains(spark, d):
    probes = X.table(spark, d, "part").select(F.concat(F.lit("supp:"), (F.col("p_partkey") % 10 + 1).cast("string")).alias("key"), F.col("p_partkey").alias("member")).distinct()
    return C.set_contains(X.set_members(spark, d), probes)


@query("""SELECT 'cust:' || o_custkey AS key, count(DISTINCT o_orderkey) AS n, min(o_orderkey * 3) AS least, max(o_orderkey * 3) AS most,
  CASE WHEN max(o_orderkey * 3) < 32768 THEN 2 WHEN max(o_orderkey * 3) < 2147483648 THEN 4 ELSE 8 END AS width FROM orders GROUP BY 1""")
def intset_width(spark, d):
    return C.intset_width(X.intset_members(spark, d))


@query("WITH r AS (SELECT 'cust:' || o_custkey AS key, o_orderkey * 3 AS member, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) SELECT key, member FROM r WHERE i = 3")
def intset_at(spark, d):
    return C.intset_at(X.intset_members(spark, d), 2)


@query(f"WITH {_H} SELECT key, count(*) AS fields, sum(octet_length(encode(value)))::BIGINT AS value_bytes FROM h GROUP BY key")
def hash_summary(spark, d):
    return C.hash_summary(X.hash_fields(spark, d))


@query("SELECT 'part:' || p_partkey AS key, (p_size + 7)::BIGINT AS value FROM part")
def hash_increment(spark, d):
    return C.hash_increment(X.hash_fields(spark, d), "size", 7)


def _seek_ms() -> int:
    return 1704412800000  # 2024-01-05


@query(f"WITH {_ST}, m AS (SELECT max((ms, seq)) AS f FROM st WHERE (ms, seq) <= ({_seek_ms()}, 0)) SELECT st.* FROM st, m WHERE (ms, seq) >= f")
def stream_seek_le(spark, d):
    return C.seek(X.stream_entries(spark, d), "le", _seek_ms()).select("ms", "seq", "event_type", "user_id")


@query(f"WITH {_ST} SELECT * FROM st WHERE (ms, seq) > ({_seek_ms()}, 0)")
def stream_seek_gt(spark, d):
    return C.seek(X.stream_entries(spark, d), "gt", _seek_ms()).select("ms", "seq", "event_type", "user_id")


@query(f"WITH {_ST}, m AS (SELECT min((ms, seq)) AS f FROM st WHERE (ms, seq) >= ({_seek_ms()}, 0)) SELECT st.* FROM st, m WHERE (ms, seq) <= f")
def stream_seek_back_ge(spark, d):
    return C.seek_back(X.stream_entries(spark, d), "ge", _seek_ms()).select("ms", "seq", "event_type", "user_id")


def _elements(spark, d):
    rows = X.table(spark, d, "lineitem").select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("key"), F.col("l_partkey").cast("string").alias("elem"))
    return keys.dealt(rows)[0].distinct()


_E = "e AS (SELECT DISTINCT 'order:' || l_orderkey AS key, l_partkey::VARCHAR AS elem FROM lineitem)"


@query(f"""WITH {_E}, r AS (SELECT e.key, elem, row_number() OVER (PARTITION BY e.key ORDER BY coalesce(p_size, 0), elem) - 1 AS place, p_brand, p_type FROM e LEFT JOIN part ON p_partkey = elem::BIGINT)
  SELECT key, place, elem, elem AS get_0, p_brand AS get_1, p_type AS get_2 FROM r WHERE place BETWEEN 1 AND 2""")
def sort_by_get(spark, d):
    rows = C.sort_elements(_elements(spark, d), by="part:*->size", lookup=X.hash_fields(spark, d), get=("#", "part:*->brand", "part:*->type"), offset=1, count=2)
    return rows.select("key", "place", "elem", "get_0", "get_1", "get_2")


@query(f"WITH {_E} SELECT key, elem, row_number() OVER (PARTITION BY key ORDER BY elem DESC) - 1 AS place FROM e")
def sort_alpha_desc(spark, d):
    return C.sort_elements(_elements(spark, d), alpha=True, desc=True).select("key", "elem", "place")


@query(f"WITH {_E} SELECT key, elem, row_number() OVER (PARTITION BY key ORDER BY elem::DOUBLE, elem) - 1 AS place FROM e")
def sort_numeric(spark, d):
    return C.sort_elements(_elements(spark, d)).select("key", "elem", "place")


# --- memory, expiry, change log ---

_COST = "(octet_length(encode(key)) + octet_length(encode(val)) + 64 + CASE WHEN expire_at_ms IS NULL THEN 0 ELSE 24 END)"


@query(f"WITH {_KS} SELECT db, count(*) AS keys, sum({_COST})::BIGINT AS bytes FROM ks GROUP BY db")
def memory_usage(spark, d):
    return memory.usage(X.keyspace(spark, d))


_WCOST = "(octet_length(encode(key)) + coalesce(octet_length(encode(val)), 0) + 64 + CASE WHEN expire_at_ms IS NULL THEN 0 ELSE 24 END)"
_SCORES = {"lru": f"{NOW_MS} - access_ms", "lfu": "255 - freq", "ttl": "-expire_at_ms", "random": "('0x' || substr(md5('evict' || key), 1, 15))::BIGINT"}


def _evictions() -> None:
    """A query for each policy that evicts."""
    for policy in memory.POLICIES[1:]:
        scope, _, kind = policy.partition("-")
        rows = "WHERE expire_at_ms IS NOT NULL" if scope == "volatile" else ""
        oracle = f"""WITH {_WK}, r AS (SELECT db, key, ({_SCORES[kind]})::BIGINT AS score, ({_WCOST})::BIGINT AS bytes FROM wk {rows}), t AS (SELECT sum(bytes) // 3 AS excess FROM r),
          c AS (SELECT *, sum(bytes) OVER (ORDER BY score DESC, key, db ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r) SELECT db, key, score, bytes FROM c, t WHERE coalesce(before, 0) < excess"""

        def evict(spark, d, policy=policy):
            k = X.wide_keyspace(spark, d)
            timed = k.filter("expire_at_ms IS NOT NULL") if policy.startswith("volatile") else k
            excess = timed.agg(F.sum(memory.cost())).first()[0] // 3
            return memory.evict(k, policy, excess, NOW_MS)

        evict.__name__ = "evict_" + policy.replace("-", "_")
        query(oracle)(evict)


_evictions()


@query(f"""WITH {_KS}, r AS (SELECT db, key, ({NOW_MS} - access_ms)::BIGINT AS score, ({_COST})::BIGINT AS bytes FROM ks), c AS (SELECT *, sum(bytes) OVER (ORDER BY score DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
  SELECT db, key, score, bytes FROM c WHERE coalesce(before, 0) < 200000""")
def evict_lru_topk(spark, d):
    return memory.evict(X.keyspace(spark, d), "allkeys-lru", 200_000, NOW_MS)


@query(f"WITH {_KS} SELECT sum({_COST})::BIGINT AS bytes, sum({_COST}) > 100000 AS refuse FROM ks")
def oom_gate(spark, d):
    return memory.over_limit(X.keyspace(spark, d), 100_000, "noeviction")


@query(f"WITH {_KS} SELECT db, key, 'expired' AS event FROM ks WHERE expire_at_ms <= {NOW_MS}")
def active_expire(spark, d):
    return memory.active_expire(X.keyspace(spark, d), NOW_MS)


@query(f"""WITH {_KS}, e AS (SELECT key FROM ks WHERE expire_at_ms <= {NOW_MS})
  SELECT '__keyspace@0__:' || key AS channel, 'expired' AS message FROM e UNION ALL SELECT '__keyevent@0__:expired', key FROM e""")
def notify_channels(spark, d):
    return writes.notifications(memory.active_expire(X.keyspace(spark, d), NOW_MS))


@query(f"""WITH {_MU}, w AS (SELECT key, max(seq) AS last FROM mu WHERE cmd <> 'PERSIST' GROUP BY key), p AS (SELECT key, max(seq) AS kept FROM mu WHERE cmd = 'PERSIST' GROUP BY key)
  SELECT mu.key, mu.val, CASE WHEN coalesce(kept > last, false) THEN NULL ELSE mu.expire_at_ms END AS expire_at_ms FROM mu JOIN w ON mu.key = w.key AND mu.seq = w.last LEFT JOIN p ON mu.key = p.key WHERE mu.cmd = 'SET'""")
def mutation_fold(spark, d):
    return writes.fold(X.mutations(spark, d))


# --- scalars, sketches, introspection ---

_NUM = "n AS (SELECT unnest(['0', '-0', '7', '007', ' 7', '+7', '-12', '9223372036854775807', '9223372036854775808', '1.5', '', 'x', '12a']) AS t)"


@query(f"WITH {_NUM} SELECT t, CASE WHEN regexp_full_match(t, '0|-?[1-9][0-9]*') THEN try_cast(t AS BIGINT) END AS n FROM n")
def strict_numbers(spark, d):
    rows = spark.createDataFrame([(t,) for t in ("0", "-0", "7", "007", " 7", "+7", "-12", "9223372036854775807", "9223372036854775808", "1.5", "", "x", "12a")], "t string")
    return rows.select("t", scalars.strict_long(F.col("t")).alias("n"))


@query("SELECT event_type AS key, count(DISTINCT user_id) AS ones, max(user_id) AS highest FROM events GROUP BY 1")
def bitmap_summary(spark, d):
    return extras.bit_summary(X.table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("value")))


@query("SELECT user_id AS value FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def bitmap_and(spark, d):
    return extras.bit_combine(X.table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("value")), "view", "error", "and")


@query("SELECT 'user:' || user_id AS key, sum(event_id)::BIGINT AS value FROM events GROUP BY 1")
def increment_log(spark, d):
    return extras.increment(X.table(spark, d, "events").select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("by")))


@query("SELECT 'num:' || c_custkey AS key, substr(c_name, 10, 4) AS part FROM customer")
def get_range(spark, d):
    rows = X.table(spark, d, "customer")
    return rows.select(F.concat(F.lit("num:"), F.col("c_custkey").cast("string")).alias("key"), extras.get_range(F.col("c_name"), 9, 12).cast("string").alias("part"))


@query()
def hll_count(spark, d):
    return extras.cardinality(X.table(spark, d, "events"), "user_id", "event_type")


@query("""WITH p AS (SELECT c_name AS member, (c_custkey % 360 - 180)::DOUBLE AS lon, (c_custkey % 170 - 85)::DOUBLE AS lat FROM customer),
  m AS (SELECT *, 2 * 6372797.560856 * asin(sqrt(pow(sin((radians(lat) - radians(50)) / 2), 2) + cos(radians(50)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(10)) / 2), 2))) AS metres FROM p)
  SELECT member, lon, lat, floor(metres)::BIGINT AS metres FROM m WHERE metres <= 6000000""")
def geo_radius(spark, d):
    points = X.table(spark, d, "customer").select(F.col("c_name").alias("member"), (F.col("c_custkey") % 360 - 180).cast("double").alias("lon"), (F.col("c_custkey") % 170 - 85).cast("double").alias("lat"))
    return extras.geo_search(points, 10.0, 50.0, 6_000_000.0).withColumn("metres", F.floor("metres"))


@query("SELECT o_orderkey, CASE WHEN cents % 100 = 0 THEN (cents // 100)::VARCHAR WHEN cents % 10 = 0 THEN (cents / 100)::DECIMAL(18,1)::VARCHAR ELSE (cents / 100)::DECIMAL(18,2)::VARCHAR END AS text FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders)")
def float_text(spark, d):
    price = F.round(F.col("o_totalprice") * 100) / 100
    return X.table(spark, d, "orders").select("o_orderkey", codecs.float_text_udf()(price).alias("text"))


@query("SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, true AS same FROM documents")
def lzf_round_trip(spark, d):
    return codecs.lzf_checked(X.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


@query(f"WITH {_KS} SELECT key, val, NULL::BIGINT AS expire_at_ms, NULL::VARCHAR AS error FROM live")
def dump_restore(spark, d):
    sealed = server.dump(X.keyspace(spark, d), NOW_MS).withColumn("ttl_ms", F.lit(0).cast("long"))
    return server.restore(sealed, NOW_MS)


@query()
def command_catalogue(spark, d):
    return server.catalogue(spark)


# --- writes on a table of several databases and all types, with repeated commands ---

_OLD = "CASE WHEN type = 'string' THEN val END"


def _wide_set(pick: str, applied: str, at: str = "NULL") -> str:
    return f"""WITH {_WK}, {_WB}, n AS (SELECT key, arg_{pick}(val, ordinal) AS nv FROM wb GROUP BY key), h AS (SELECT * FROM wl WHERE db = 1),
      j AS (SELECT coalesce(h.key, n.key) AS key, type, val, expire_at_ms, access_ms, nv, coalesce(nv IS NOT NULL AND ({applied}), false) AS applied FROM h FULL JOIN n ON h.key = n.key)
      SELECT db, key, type, val, expire_at_ms, access_ms, {_OLD} AS old_val, false AS applied FROM wl WHERE db <> 1
      UNION ALL SELECT 1, key, CASE WHEN applied THEN 'string' ELSE type END, CASE WHEN applied THEN nv ELSE val END, CASE WHEN applied THEN {at} ELSE expire_at_ms END,
        CASE WHEN applied THEN {NOW_MS} ELSE access_ms END, {_OLD}, applied FROM j WHERE type IS NOT NULL OR applied"""


@query(_wide_set("max", "true"))
def set_in_one_db(spark, d):
    return writes.set_keys(X.wide_keyspace(spark, d), _commands(spark, d), NOW_MS, db=1)


@query(_wide_set("max", "coalesce(type, 'string') = 'string'", "expire_at_ms"))
def set_get_wrong_type(spark, d):
    return writes.set_keys(X.wide_keyspace(spark, d), _commands(spark, d), NOW_MS, get=True, keep_ttl=True, db=1)


@query(_wide_set("min", "type IS NULL"))
def set_nx_in_one_db(spark, d):
    return writes.set_keys(X.wide_keyspace(spark, d), _commands(spark, d), NOW_MS, only="NX", db=1)


@query(f"SELECT db, key, type, val, expire_at_ms, access_ms FROM ({_wide_set('max', 'true')})")
def mset_in_one_db(spark, d):
    return writes.mset(X.wide_keyspace(spark, d), _commands(spark, d), NOW_MS, db=1)


@query(f"WITH {_WK}, {_WB}, k AS (SELECT DISTINCT key FROM wb), h AS (SELECT * FROM wl WHERE db = 2) SELECT k.key, CASE WHEN type = 'string' THEN val END AS val, coalesce(type <> 'string', false) AS wrong_type FROM k LEFT JOIN h USING (key)")
def get_wrong_type(spark, d):
    return keys.get(X.wide_keyspace(spark, d), _commands(spark, d).select("key").distinct(), NOW_MS, db=2)


@query(f"WITH {_WK}, {_WB}, k AS (SELECT DISTINCT key FROM wb), h AS (SELECT * FROM wl WHERE db = 2) SELECT k.key, coalesce(type, 'none') AS type FROM k LEFT JOIN h USING (key)")
def type_of_every_type(spark, d):
    return keys.type_of(X.wide_keyspace(spark, d), _commands(spark, d).select("key").distinct(), NOW_MS, db=2)


@query(f"WITH {_WK}, {_WB} SELECT count(*) AS n FROM wb JOIN wl USING (key) WHERE db = 2")
def touch_count(spark, d):
    return keys.touched(X.wide_keyspace(spark, d), _commands(spark, d), NOW_MS, db=2)


@query(f"WITH {_WK}, {_WB} SELECT * REPLACE (CASE WHEN db = 1 AND key IN (SELECT key FROM wb) THEN NULL ELSE expire_at_ms END AS expire_at_ms) FROM wl")
def persist_keyspace(spark, d):
    return writes.persisted(X.wide_keyspace(spark, d), _commands(spark, d), NOW_MS, db=1)


def _deadlines(spark, d) -> DataFrame:
    return _commands(spark, d).select("ordinal", "key", ((F.col("ordinal") * 37 % 21 - 6) * 86400).cast("long").alias("amount"))


def _expire_fold(condition: str, tail: str) -> str:
    """By recursion over the commands of a key, one after another."""
    test = {"": "true", "NX": "due IS NULL", "XX": "due IS NOT NULL", "GT": "due IS NOT NULL AND new > due", "LT": "due IS NULL OR new < due"}[condition]
    return f"""WITH RECURSIVE {_WK}, {_WB}, c AS (SELECT ordinal, key, ((ordinal * 37 % 21 - 6) * 86400000 + {NOW_MS})::BIGINT AS new, row_number() OVER (PARTITION BY key ORDER BY ordinal) AS n FROM wb),
      f AS (SELECT k.key, 0::BIGINT AS n, NULL::BIGINT AS ordinal, (w.key IS NOT NULL) AS alive, w.expire_at_ms AS due, NULL::INT AS reply, NULL::BOOLEAN AS gone FROM (SELECT DISTINCT key FROM wb) k LEFT JOIN (SELECT * FROM wl WHERE db = 1) w USING (key)
        UNION ALL SELECT key, n, ordinal, alive AND NOT (hit AND new <= {NOW_MS}), CASE WHEN hit AND new <= {NOW_MS} THEN NULL WHEN hit THEN new ELSE due END, hit::INT, hit AND new <= {NOW_MS}
          FROM (SELECT f.key, c.n, c.ordinal, f.alive, f.due, c.new, f.alive AND coalesce({test}, false) AS hit FROM f JOIN c ON c.key = f.key AND c.n = f.n + 1)),
      r AS (SELECT ordinal, key, reply, CASE WHEN gone THEN 'del' WHEN reply = 1 THEN 'expire' END AS event, due AS expire_at_ms FROM f WHERE n > 0) {tail}"""


def _expirations() -> None:
    for condition in ("", "NX", "XX", "GT", "LT"):
        def replies(spark, d, condition=condition):
            return writes.expire(X.wide_keyspace(spark, d), _deadlines(spark, d), NOW_MS, condition=condition or None, db=1)

        replies.__name__ = f"expire_repeated{'_' * bool(condition)}{condition.lower()}"
        query(_expire_fold(condition, "SELECT * FROM r"))(replies)


_expirations()


@query(_expire_fold("", f"""SELECT wl.* REPLACE (CASE WHEN db = 1 AND l.key IS NOT NULL THEN l.due ELSE wl.expire_at_ms END AS expire_at_ms) FROM wl
  LEFT JOIN (SELECT key, arg_max(expire_at_ms, ordinal) AS due, bool_or(event = 'del') AS gone FROM r WHERE reply = 1 GROUP BY key) l ON wl.key = l.key AND wl.db = 1 WHERE l.key IS NULL OR NOT l.gone""").replace("arg_max(", "arg_max_null("))
def expire_keyspace(spark, d):
    k = X.wide_keyspace(spark, d)
    return writes.expired_by(k, writes.expire(k, _deadlines(spark, d), NOW_MS, db=1), NOW_MS, db=1)


@query(f"WITH {_WK}, {_WB}, m AS (SELECT DISTINCT key FROM wb WHERE key NOT IN (SELECT key FROM wl WHERE db = 2)) SELECT * REPLACE (CASE WHEN db = 1 AND key IN (SELECT key FROM m) THEN 2 ELSE db END::INT AS db) FROM wl")
def move_where_free(spark, d):
    return writes.move(X.wide_keyspace(spark, d), _commands(spark, d), NOW_MS, to_db=2, db=1)


@query(f"""WITH {_WK}, {_WB}, m AS (SELECT key FROM wl WHERE db = 1 AND key IN (SELECT key FROM wb) AND key NOT IN (SELECT key FROM wl WHERE db = 2))
  SELECT 1 AS db, key, 'move_from' AS event FROM m UNION ALL SELECT 2, key, 'move_to' FROM m""")
def move_events(spark, d):
    return writes.move_events(X.wide_keyspace(spark, d), _commands(spark, d), NOW_MS, to_db=2, db=1)


@query(f"WITH {_KS}, {_PAIRS} SELECT src, dst, CASE WHEN src IN (SELECT key FROM live) THEN (dst NOT IN (SELECT key FROM live))::INT END AS reply, CASE WHEN src NOT IN (SELECT key FROM live) THEN 'no such key' END AS error FROM pairs")
def rename_replies(spark, d):
    return writes.rename_replies(X.keyspace(spark, d), _pairs(spark, d), NOW_MS, only_new=True)


@query(f"""WITH {_WK}, e AS (SELECT db, key, CASE WHEN expire_at_ms <= {NOW_MS} THEN 'expired' ELSE 'set' END AS event, CASE WHEN expire_at_ms <= {NOW_MS} THEN 'expired' ELSE type END AS class FROM wk)
  SELECT '__keyevent@' || db || '__:' || event AS channel, key AS message FROM e WHERE class IN ('expired', 'zset', 'list')""")
def notify_classes(spark, d):
    gone = F.coalesce(F.col("expire_at_ms") <= NOW_MS, F.lit(False))
    changes = X.wide_keyspace(spark, d).select("db", "key", F.when(gone, "expired").otherwise("set").alias("event"), F.when(gone, "expired").otherwise(F.col("type")).alias("class"))
    return writes.notifications(changes, "Exzl")


_SHARD8 = "slot & 7 AS shard"


@query(f"""WITH {_WB}, s AS (SELECT *, {_SHARD8} FROM {_slots('wb')})
  SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY ordinal) - 1 AS seq, key, 'SET ' || key || ' ' || val || CASE WHEN ordinal % 2 = 0 THEN ' PXAT ' || ({NOW_MS} + ordinal) ELSE '' END AS argv FROM s""")
def propagate_set(spark, d):
    return writes.propagate_set(_commands(spark, d).withColumn("expire_at_ms", F.when(F.col("ordinal") % 2 == 0, F.col("ordinal") + NOW_MS)), 8)


@query(f"""WITH {_WB}, s AS (SELECT *, {_SHARD8} FROM {_slots('wb')})
  SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY ordinal) - 1 AS seq, key, 'RESTORE ' || key || ' ' || CASE WHEN ordinal % 2 = 0 THEN {NOW_MS} + ordinal ELSE 0 END || ' ' || hex(encode(val)) || ' ABSTTL' AS argv FROM s""")
def propagate_restore(spark, d):
    rows = _commands(spark, d).select("ordinal", "key", F.col("val").cast("binary").alias("payload"), F.when(F.col("ordinal") % 2 == 0, F.col("ordinal") + NOW_MS).alias("expire_at_ms"))
    return writes.propagate_restore(rows, 8)


@query("WITH c AS (SELECT l_orderkey AS id, 'part:' || l_partkey AS key FROM lineitem) SELECT id, array_to_string(list_sort(list(DISTINCT slot & 15)), ',') AS shards FROM " + _slots("c") + " GROUP BY id")
def command_shards(spark, d):
    rows = X.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))).alias("keys"))
    return keys.command_shards(rows, 16).select("id", F.array_join(F.transform("shards", lambda x: x.cast("string")), ",").alias("shards"))


@query(f"""WITH {_KS}, s AS (SELECT key, slot & 7 AS shard, list_reduce(list_prepend(0, range(4)::INT[]), lambda a, i: a | (((slot >> 3) >> i & 1) << (3 - i))) AS place FROM {_slots('live')}),
  b AS (SELECT shard * 16 + place AS spot, count(*) AS n FROM s GROUP BY 1), r AS (SELECT spot, coalesce(sum(n) OVER (ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b WHERE spot >= 2 * 16 + 5)
  SELECT key FROM s WHERE shard * 16 + place IN (SELECT spot FROM r WHERE before < 100) AND regexp_full_match(key, '.*[1-5]')""")
def scan_page(spark, d):
    return keys.scan_page(X.keyspace(spark, d), NOW_MS, 5 << 3 | 2, count=100, shards=8, bits=4, pattern="*[1-5]")[0]


@query(f"""WITH {_KS}, b AS (SELECT o_orderkey AS ordinal, 'event:' || o_orderkey AS key, o_orderkey::VARCHAR AS val, (o_orderkey % 5 * 1000 - 1000)::BIGINT AS ttl FROM orders),
  n AS (SELECT b.*, CASE WHEN ttl < 0 THEN 'invalid ttl' WHEN b.key IN (SELECT key FROM live) THEN 'BUSYKEY' END AS error FROM b) SELECT * FROM live
  UNION ALL SELECT 0, key, 'string', val, CASE WHEN ttl > 0 THEN {NOW_MS} + ttl END, {NOW_MS} - 60000 FROM n WHERE error IS NULL""")
def restore_where_free(spark, d):
    return server.restore_into(X.keyspace(spark, d), _sealed(spark, d), NOW_MS, idle_s=60)[0]


@query(f"""WITH {_KS}, b AS (SELECT o_orderkey AS ordinal, 'event:' || o_orderkey AS key, (o_orderkey % 5 * 1000 - 1000)::BIGINT AS ttl FROM orders)
  SELECT ordinal, b.key, CASE WHEN ttl < 0 THEN 'invalid ttl' WHEN b.key IN (SELECT key FROM live) THEN 'BUSYKEY' END AS error FROM b""")
def restore_replies(spark, d):
    return server.restore_into(X.keyspace(spark, d), _sealed(spark, d), NOW_MS)[1]


def _sealed(spark, d) -> DataFrame:
    i = F.col("o_orderkey")
    return X.table(spark, d, "orders").select(i.alias("ordinal"), F.concat(F.lit("event:"), i.cast("string")).alias("key"), (i % 5 * 1000 - 1000).cast("long").alias("ttl_ms"), codecs.dump_udf()(i.cast("string").cast("binary")).alias("payload"))


# --- more algebra of collections ---


@query(f"WITH {_Z} SELECT * FROM z WHERE NOT (score >= 50000 AND score < 150000)")
def zset_delete_by_score(spark, d):
    return C.zset_delete_by_score(X.zset_members(spark, d), 50000.0, 150000.0, high_open=True)[0].select("key", "member", "score")


@query(f"WITH {_Z} SELECT * FROM z WHERE member >= 'order:2' AND member < 'order:5'")
def zset_deleted_by_lex(spark, d):
    return C.zset_delete_by_lex(X.zset_members(spark, d), "order:2", "order:5", high_open=True)[1].select("key", "member", "score")


@query(f"WITH {_ZT} SELECT key, arg_min(member, (score, member)) AS first, min(score) AS first_score, arg_max(member, (score, member)) AS last, max(score) AS last_score FROM z GROUP BY key")
def zset_ends(spark, d):
    return C.zset_ends(X.zset_members(spark, d, ties=True))


@query(f"WITH {_ZT}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS i FROM z) SELECT key, min(i) AS first_rank, max(i) AS last_rank FROM r WHERE score > 1 AND score <= 3 GROUP BY key")
def zset_ends_in_range(spark, d):
    return C.zset_ends_in_range(X.zset_members(spark, d, ties=True), 1.0, 3.0, low_open=True)


@query(f"WITH {_ZT}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) AS i FROM z) SELECT key, member, score FROM r WHERE i <= 2")
def zset_pop_highest(spark, d):
    return C.zset_pop(X.zset_members(spark, d, ties=True), 2, highest=True)[1]


@query(f"WITH {_L}, n AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM l) SELECT key, n - 1 - pos AS place, elem FROM n WHERE n - pos <= 3")
def list_pop(spark, d):
    return C.list_pop(X.list_items(spark, d), 3, front=False)[1]


@query(f"WITH {_L} SELECT key, pos - 3 AS pos, elem FROM l WHERE pos >= 3")
def list_popped(spark, d):
    return C.list_pop(X.list_items(spark, d), 3)[0]


@query(f"WITH {_L} SELECT key, arg_min(elem, pos) AS head, arg_max(elem, pos) AS tail FROM l GROUP BY key")
def list_ends(spark, d):
    return C.list_ends(X.list_items(spark, d))


@query(f"WITH {_L} SELECT key, ceil(count(*) / 4.0)::BIGINT AS nodes FROM l GROUP BY key")
def list_nodes(spark, d):
    return C.list_nodes(X.list_items(spark, d), 4)


@query(f"WITH {_L} SELECT key, min(pos) AS pos FROM l WHERE elem = 'view' AND pos >= 1 AND (pos - 1) % 2 = 0 GROUP BY key")
def list_find_stride(spark, d):
    return C.list_find(X.list_items(spark, d), "view", start=1, skip=1)


@query("""WITH e AS (SELECT 'order:' || l_orderkey AS key, (l_partkey * CASE WHEN l_linenumber % 2 = 0 THEN -1777 ELSE 1 END)::BIGINT AS v FROM lineitem)
  SELECT key, count(*) AS n, (7 + sum(1 + CASE WHEN v BETWEEN 0 AND 127 THEN 1 WHEN v BETWEEN -4096 AND 4095 THEN 2 WHEN v BETWEEN -32768 AND 32767 THEN 3 WHEN v BETWEEN -8388608 AND 8388607 THEN 4 WHEN v BETWEEN -2147483648 AND 2147483647 THEN 5 ELSE 9 END))::BIGINT AS bytes FROM e GROUP BY key""")
def list_packed(spark, d):
    value = F.col("l_partkey") * F.when(F.col("l_linenumber") % 2 == 0, -1777).otherwise(1)
    return C.list_packed(X.table(spark, d, "lineitem").select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("key"), value.cast("string").alias("elem")))


@query("""WITH s AS (SELECT 'cust:' || o_custkey AS key, o_orderkey * 3 AS member FROM orders UNION SELECT 'cust:' || c_custkey, c_custkey FROM customer)
  SELECT key, member FROM s WHERE (key, member) NOT IN (SELECT ('cust:' || o_custkey, o_orderkey * 3) FROM orders WHERE o_orderkey % 2 = 0)""")
def intset_edit(spark, d):
    s = X.intset_members(spark, d)
    add = X.table(spark, d, "customer").select(F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_custkey").alias("member"))
    return C.intset_edit(s, add, s.filter(F.col("member") % 2 == 0))


@query("SELECT 'cust:' || o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) - 1 AS place, o_orderkey * 3 AS member FROM orders")
def intset_walk_back(spark, d):
    return C.intset_walk(X.intset_members(spark, d), backward=True)


@query("SELECT 'cust:' || o_custkey AS key, arg_min(o_orderkey * 3, md5('r1:cust:' || o_custkey || ':' || (o_orderkey * 3))) AS member FROM orders GROUP BY o_custkey")
def intset_random(spark, d):
    return C.set_random(X.intset_members(spark, d), "r1")


_MAP = "m AS (SELECT 'cust:' || o_custkey AS key, 'order:' || o_orderkey AS name, o_orderstatus AS value FROM orders)"


def _map(spark, d) -> DataFrame:
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    return X.table(spark, d, "orders").select(text("cust:", "o_custkey").alias("key"), text("order:", "o_orderkey").alias("name"), F.col("o_orderstatus").alias("value"))


@query(f"""WITH {_MAP} SELECT key, name, CASE WHEN value = 'O' THEN 'open' ELSE value END AS value FROM m WHERE value <> 'F' UNION ALL SELECT DISTINCT key, 'order:', 'none' FROM m""")
def map_edit(spark, d):
    m = _map(spark, d)
    put = m.filter("value = 'O'").withColumn("value", F.lit("open")).union(m.select("key", F.lit("order:").alias("name"), F.lit("none").alias("value")).distinct())
    return C.map_edit(m, put, m.filter("value = 'F'"))


@query(f"WITH {_MAP}, p AS (SELECT 'cust:' || c_custkey AS key, 'order:' || (c_custkey * 2) AS name FROM customer) SELECT p.key, p.name, value FROM p LEFT JOIN m USING (key, name)")
def map_find(spark, d):
    c = F.col("c_custkey")
    return C.map_find(_map(spark, d), X.table(spark, d, "customer").select(F.concat(F.lit("cust:"), c.cast("string")).alias("key"), F.concat(F.lit("order:"), (c * 2).cast("string")).alias("name")))


@query(f"WITH {_MAP} SELECT key, min(name) AS first, max(name) AS last FROM m GROUP BY key")
def map_ends(spark, d):
    return C.map_ends(_map(spark, d))


@query(f"WITH {_MAP} SELECT key, row_number() OVER (PARTITION BY key ORDER BY name DESC) - 1 AS place, name, value FROM m")
def map_walk_back(spark, d):
    return C.map_walk(_map(spark, d), backward=True)


@query(f"""WITH {_E}, r AS (SELECT 'sorted:' || key AS key, row_number() OVER (PARTITION BY key ORDER BY elem::DOUBLE, elem) - 1 AS pos, elem FROM e) SELECT * FROM r UNION ALL SELECT 'other', 0, 'x'""")
def sort_store(spark, d):
    found = C.sort_elements(_elements(spark, d))
    there = spark.createDataFrame([("other", 0, "x"), ("sorted:order:1", 0, "old")], "key string, pos long, elem string")
    return C.sort_store(there, found, F.concat(F.lit("sorted:"), F.col("key")))


@query("SELECT DISTINCT 'user:' || user_id AS key, 'One or more scores can''t be converted into double' AS error FROM events")
def sort_errors(spark, d):
    return C.sort_errors(X.list_items(spark, d))


@query()
def command_info(spark, d):
    return server.command_info(spark)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
