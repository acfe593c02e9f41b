"""Keyspace relations built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The moment every query is asked at: 2024-01-16T00:00:00Z in milliseconds.
NOW_MS = 1705363200000
DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str) -> Column:
    """Epoch milliseconds of a timestamp without zone, taken as UTC, cut (not rounded)."""
    return F.unix_millis(F.col(column).cast("timestamp"))


def keyspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One string key for each event; a third never expires, the others expire 0 to 19 days after they were written."""
    at = millis("ts")
    return table(spark, sf_dir, "events").select(
        F.lit(0).alias("db"), F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("key"), F.lit("string").alias("type"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("val"),
        F.when(F.col("event_id") % 3 != 0, at + F.col("event_id") % 20 * DAY_MS).alias("expire_at_ms"), at.alias("access_ms"),
    )


#: Types by turns.
TYPES = ("string", "list", "hash", "set", "zset", "stream")


def wide_keyspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of every type in three databases that share their names, with access counters; three in four have deadlines."""
    at, i = millis("ts"), F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.floor(i / 7) % 6 + 1).cast("int"))
    kind = F.when(i % 2 == 0, "string").otherwise(kind)
    return table(spark, sf_dir, "events").select(
        (i % 3).cast("int").alias("db"), F.concat(F.lit("k:"), F.floor(i / 3).cast("string")).alias("key"), kind.alias("type"),
        F.when(kind == "string", F.col("value").cast("decimal(18,2)").cast("string")).alias("val"),
        F.when(i % 4 != 0, at + i % 20 * DAY_MS).alias("expire_at_ms"), at.alias("access_ms"), (i * 7 % 256).cast("int").alias("freq"),
    )


def string_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with integer, short and long encodings: customer numbers, customer names, document texts."""
    customers, docs = table(spark, sf_dir, "customer"), table(spark, sf_dir, "documents")
    row = lambda prefix, key, val: (F.concat(F.lit(prefix), F.col(key).cast("string")).alias("key"), F.col(val).cast("string").alias("val"))
    return customers.select(*row("num:", "c_custkey", "c_custkey")).union(customers.select(*row("name:", "c_custkey", "c_name"))).union(docs.select(*row("doc:", "doc_id", "text")))


def tagged_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat(F.lit("{user:"), F.col("user_id").cast("string"), F.lit("}:"), F.col("event_id").cast("string")).alias("key"))


def zset_members(spark: SparkSession, sf_dir: str, ties: bool = False) -> DataFrame:
    """A sorted set of orders for each customer, by price; with ``ties``, by the digit of the priority."""
    score = F.substring("o_orderpriority", 1, 1).cast("double") if ties else F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("key"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("member"), score.alias("score")
    )


def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of event types for each user, in event order, positions from 0."""
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, sf_dir, "events").select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), pos.cast("long").alias("pos"), F.col("event_type").alias("elem"))


def set_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("supp:"), F.col("l_suppkey").cast("string")).alias("key"), F.col("l_partkey").alias("member")).distinct()


def intset_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("key"), (F.col("o_orderkey") * 3).alias("member"))


def hash_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    pairs = F.explode(F.create_map(*[x for f in ("p_brand", "p_type", "p_size") for x in (F.lit(f[2:]), F.col(f).cast("string"))])).alias("field", "value")
    return parts.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("key"), pairs)


def stream_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of one stream, numbered (ms, seq)."""
    events = table(spark, sf_dir, "events").withColumn("ms", millis("ts"))
    seq = (F.row_number().over(W.partitionBy("ms").orderBy("event_id")) - 1).cast("long")
    return events.select(F.lit("stream:events").alias("key"), "ms", seq.alias("seq"), "event_type", "user_id")


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command for each event, in event order: click and view set, purchase sets with a day to live, signup persists, error deletes."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), millis("ts").alias("ts_ms"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        F.when(kind.isin("click", "view", "purchase"), "SET").when(kind == "signup", "PERSIST").otherwise("DEL").alias("cmd"),
        F.when(kind.isin("click", "view", "purchase"), F.col("event_id").cast("string")).alias("val"),
        F.when(kind == "purchase", millis("ts") + DAY_MS).alias("expire_at_ms"),
    )
