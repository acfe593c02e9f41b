"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

DataFrame functions only. Documents are dealt into shards by a hash of their id, so a source that holds
a third of all rows is spread over every shard; the number of shards follows the corpus (``shard_words``). A source too small for all of them is spread over as many as it has 64ths of a shard's words for, one at
least, so its part in a shard is never a sliver that rounds to nothing in each.
A shard's blocks all have the same number of words, a sixteenth of its smallest source's part or less. Seats (blocks to take) go to the shard's sources by highest
quotients ``votes / (2 * seats + 1)``; which blocks a source gives is drawn by a seeded permutation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.durable import settle

SHARD_WORDS = 4_000_000
BLOCKS_PER_SHARD = 4096
#: Parts that a shard's words would make, and blocks that the smallest part is cut into at least.
PARTS_PER_SHARD, PART_BLOCKS = 64, 16
#: Multipliers of the block permutation: primes above any number of blocks in a shard and source.
STRIDES = (15485863, 15485867, 15485917, 15485927, 15485933, 15485941, 15485959, 15485989)


def _hash(*parts: Column | str) -> Column:
    """60 bits of MD5, which other SQL engines have too."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Word target of each source of (source, source_size).

    Sources in code point order (null last) get ``weights`` in turn of ``share`` times all words. A target stops at
    ``cap`` times its source; the excess is shared again by weight. That fixed point is a level: the sources
    with the smallest cap per weight are full, and the others get level * weight.
    """
    ordered = sources.withColumn("source_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int"))
    ordered = ordered.withColumn("weight", w.cast("double")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_room = W.orderBy(F.col("most") / F.col("weight"), "source_rank")
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy()
    levels = ordered.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    levels = levels.withColumn(
        "level",
        (F.col("total") * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    open_level = F.when(F.col("most") / F.col("weight") > F.col("level"), F.col("level"))
    levels = levels.withColumn("water", F.max(open_level).over(everything))  # of the first open one: later figures are lower
    target = F.when(F.col("water").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("water") * F.col("weight")))
    return levels.select("source", "source_rank", "source_size", target.alias("target"))


def quotas(parts: DataFrame, goals: DataFrame, blocks_per_shard: int) -> DataFrame:
    """Blocks that each (shard, source) gives: Sainte-Laguë within each shard.

    With q = votes / block, n sources and e = (n + 1) / (2 * sum of q), a source's seats lie within
    q * (1 - e) - 1/2 and q * (1 + e) + 1/2, so only those quotients are ranked.
    """
    shard = W.partitionBy("shard")
    votes = (
        parts.join(goals, parts["source"].eqNullSafe(goals["source"])).drop(goals["source"])
        .withColumn("block", F.greatest(F.lit(1), F.least(F.floor(F.sum("part_size").over(shard) / blocks_per_shard), F.floor(F.min(F.when(F.col("part_size") > 0, F.col("part_size"))).over(shard) / PART_BLOCKS))).cast("long"))
        .withColumn("votes", F.when(F.col("source_size") > 0, F.col("target") * F.col("part_size") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("fair", F.col("votes") / F.col("block"))
        .withColumn("seats", F.round(F.sum("fair").over(shard)).cast("long"))
        .withColumn("slack", (F.count("*").over(shard) + 1) / (F.lit(2.0) * F.greatest(F.sum("fair").over(shard), F.lit(0.5))))
        .withColumn("low", F.greatest(F.lit(0), F.floor(F.col("fair") * (1 - F.col("slack")) - 0.5)).cast("long"))
        .withColumn("high", F.ceil(F.col("fair") * (1 + F.col("slack")) + 0.5).cast("long"))
    )
    offers = votes.filter("votes > 0").select(
        "shard", "source_rank", "low", "seats", "votes", F.explode(F.sequence("low", "high")).alias("seat")
    )
    offers = offers.withColumn("quotient", F.col("votes") / (F.lit(2.0) * F.col("seat") + 1.0))
    place = F.row_number().over(shard.orderBy(F.desc("quotient"), "source_rank", "seat"))
    sure = votes.filter("votes > 0").groupBy("shard").agg(F.sum("low").alias("sure"))
    won = (
        offers.withColumn("place", place).join(sure, "shard").filter(F.col("place") <= F.col("seats") - F.col("sure"))
        .groupBy("shard", "source_rank").agg(F.count("*").alias("won"))
    )
    return (
        votes.join(won, ["shard", "source_rank"], "left")
        .withColumn("quota", F.when(F.col("votes") > 0, F.col("low") + F.coalesce("won", F.lit(0))).otherwise(F.lit(0)))
        .withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("part_size") / F.col("block"))).cast("long"))
        .select("shard", "source", "source_rank", "source_size", "target", "block", "n_blocks", "quota")
    )


def mix(
    docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix-1",
    shard_words: int = SHARD_WORDS, blocks_per_shard: int = BLOCKS_PER_SHARD, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken), one for each row of ``docs``.

    Null or empty text has size 0 and gives nothing; null is a source of its own, the last. Rows with equal ids go
    to one shard and count each on its own; rows with null ids are dealt by their texts. Very long texts are cut by blocks like any other. Other columns are not read. An empty table gives an
    empty result. ``taken`` is at most ``cap`` (2 or less) times the size.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    spot = _hash(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.md5(text_col), F.lit("")))
    rows = settle(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), spot.alias("spot")), "mix-sizes")
    sources = settle(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    n_shards = max(1, -(-total // shard_words))
    home = _hash(F.lit(seed), F.lit("home"), F.coalesce("source", F.lit("")))
    spread = sources.select(F.col("source").alias("h_source"), F.least(F.lit(n_shards), F.greatest(F.lit(1), F.floor(F.col("source_size") / max(1, shard_words // PARTS_PER_SHARD)))).cast("long").alias("wide"), home.alias("home"))
    # a few rows a source: Spark broadcasts them while they are few, and splits large sources where it does not
    rows = rows.join(spread, F.col("source").eqNullSafe(F.col("h_source"))).withColumn("shard", F.pmod(F.pmod("spot", "wide") + F.pmod("home", F.lit(n_shards)), F.lit(n_shards))).drop("h_source", "wide", "home")

    parts = settle(rows.groupBy("shard", "source").agg(F.sum("size").alias("part_size")), "mix-parts")
    goals = targets(sources, weights, share, cap)
    gives = settle(quotas(parts, goals, blocks_per_shard), "mix-quotas").withColumnsRenamed({"shard": "q_shard", "source": "q_source"})

    joined = rows.join(gives, (rows["shard"] == gives["q_shard"]) & rows["source"].eqNullSafe(gives["q_source"]))
    stream = W.partitionBy("shard", "source").orderBy("spot", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    rounds = F.least(F.lit(int(cap)), F.floor(F.col("quota") / F.col("n_blocks"))).cast("long")
    left = F.when(F.floor(F.col("quota") / F.col("n_blocks")) >= int(cap), F.lit(0)).otherwise(F.col("quota") % F.col("n_blocks"))
    draw = _hash(F.lit(seed), "blocks", F.col("shard").cast("string"), F.col("source_rank").cast("string"))
    joined = (
        joined.withColumn("stop", F.sum("size").over(stream)).withColumn("start", F.col("stop") - F.col("size"))
        .withColumn("rounds", rounds).withColumn("left", left.cast("long"))
        .withColumn("stride", F.element_at(F.array(*map(F.lit, STRIDES)), (draw % len(STRIDES) + 1).cast("int")).cast("long"))
        .withColumn("shift", draw % F.col("n_blocks"))
    )
    drawn = lambda k: ((k * F.col("stride") + F.col("shift")) % F.col("n_blocks")) < F.col("left")
    part = lambda k: F.least(F.col("stop"), (k + 1) * F.col("block")) - F.greatest(F.col("start"), k * F.col("block"))
    first, last = F.floor(F.col("start") / F.col("block")), F.floor((F.col("stop") - 1) / F.col("block"))
    extra = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda got, k: got + F.when(drawn(k), part(k)).otherwise(F.lit(0)))
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("rounds") * F.col("size") + F.when(F.col("left") > 0, extra).otherwise(F.lit(0)))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = f"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 15))::BIGINT AS spot FROM documents),
n AS (SELECT greatest(1, ceil(coalesce(sum(size), 0) / {SHARD_WORDS}.0))::BIGINT AS n FROM rows),
homes AS (SELECT source, least(n, greatest(1, sum(size)::BIGINT // {SHARD_WORDS // PARTS_PER_SHARD})) AS wide, ('0x' || substr(md5('mix-1:home:' || coalesce(source, '')), 1, 15))::BIGINT % n AS home, n FROM rows, n GROUP BY source, n),
dealt AS (SELECT rows.*, (spot % wide + home) % n AS shard FROM rows JOIN homes ON rows.source IS NOT DISTINCT FROM homes.source),
parts AS (SELECT shard, source, sum(size)::BIGINT AS part_size FROM dealt GROUP BY ALL),
srcs AS (SELECT source, sum(part_size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM parts GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((source_rank - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS most FROM srcs),
lv AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY most / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT source, source_rank, source_size, CASE WHEN water IS NULL THEN most ELSE least(most, water * weight) END AS target
  FROM (SELECT *, max(CASE WHEN most / weight > level THEN level END) OVER () AS water FROM lv)),
v1 AS (SELECT p.shard, p.source, p.part_size, g.source_rank, g.source_size, g.target,
         greatest(1, least(floor(sum(part_size) OVER (PARTITION BY shard) / {BLOCKS_PER_SHARD}.0), floor(min(part_size) FILTER (part_size > 0) OVER (PARTITION BY shard) / {PART_BLOCKS}.0)))::BIGINT AS block,
         CASE WHEN g.source_size > 0 THEN g.target * p.part_size / g.source_size ELSE 0.0 END AS votes
  FROM parts p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source),
v2 AS (SELECT *, votes / block AS fair, round(sum(votes / block) OVER (PARTITION BY shard))::BIGINT AS seats FROM v1),
seated AS (SELECT shard, source_rank, count(*) FILTER (place <= seats) AS quota FROM (
    SELECT shard, source_rank, seats, row_number() OVER (PARTITION BY shard ORDER BY votes / (2.0::DOUBLE * seat + 1.0) DESC, source_rank, seat) AS place
    FROM (SELECT *, unnest(range(0, seats + 1)) AS seat FROM v2 WHERE votes > 0)) GROUP BY ALL),
quo AS (SELECT v2.*, coalesce(s.quota, 0) AS quota, greatest(1, ceil(part_size / block::DOUBLE))::BIGINT AS n_blocks,
    ('0x' || substr(md5('mix-1:blocks:' || v2.shard || ':' || v2.source_rank), 1, 15))::BIGINT AS draw FROM v2 LEFT JOIN seated s USING (shard, source_rank)),
cum AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.block, q.n_blocks,
    least(2, q.quota // q.n_blocks) AS rounds, CASE WHEN q.quota // q.n_blocks >= 2 THEN 0 ELSE q.quota % q.n_blocks END AS rest,
    {list(STRIDES)}[(draw % {len(STRIDES)} + 1)::INT]::BIGINT AS stride, draw % q.n_blocks AS shift,
    (sum(d.size) OVER (PARTITION BY d.shard, d.source ORDER BY d.spot, d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::BIGINT AS stop
  FROM dealt d JOIN quo q ON d.shard = q.shard AND d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE rounds * size + coalesce(list_sum(list_transform(
    list_filter(range((stop - size) // block, (stop - 1) // block + 1), lambda k: (k * stride + shift) % n_blocks < rest),
    lambda k: least(stop, (k + 1) * block) - greatest(stop - size, k * block))), 0) END::BIGINT AS taken
FROM cum
"""

QUERIES = {"op10_mixing": op10_mixing}
ORACLES = {"op10_mixing": ORACLE}
