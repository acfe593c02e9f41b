"""Quality rules by weak supervision.

Rules over a text's statistics vote good (1), bad (-1) or abstain (0). Expectation-maximisation over the counts of all vote patterns
in the corpus estimates how often each rule votes good on good and on bad texts, and the share of good ones, without labels; a text is kept if its posterior probability of being good is a half or more. With eight rules there are at most
3**8 patterns, so what the driver gathers and sends back is bounded whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkit
from tessera.llm.durable import apart, settle

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: The last byte of a line that ends a sentence.
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?:;\"')"]] = True

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_lines", "n_letter_words")


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the flags between successive bounds."""
    total = np.r_[0, np.cumsum(flags)]
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.int64)


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each text."""
    n = len(offsets) - 1
    space = textkit.SPACE[data]
    starts, ends, first = textkit.runs(~space, offsets)
    prefix = textkit.Prefix(data)
    doc = textkit.of_text(first)
    salt = textkit.mixed(np.arange(1, n + 1, dtype=np.uint64))

    grams, ok = textkit.windows(prefix(starts, ends), first, 3)
    grams = textkit.mixed(grams ^ salt[doc]) if len(doc) else grams
    ordered = np.sort(grams[ok])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    repeated = np.zeros(len(grams), bool)
    if len(twice):
        near = np.minimum(np.searchsorted(twice, grams), len(twice) - 1)
        repeated = ok & (twice[near] == grams)
    covered = repeated.copy()
    for j in (1, 2):
        covered[j:] |= repeated[:-j]

    ls, le, lfirst = textkit.runs(data != 10, offsets)
    worded = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ldoc = textkit.of_text(lfirst)
    lines = textkit.mixed(prefix(ls, le) ^ salt[ldoc]) if len(ls) else np.zeros(0, np.uint64)
    kept = np.flatnonzero(worded)
    order = kept[np.argsort(lines[kept], kind="stable")]
    again = np.zeros(len(ls), bool)
    again[order[1:][lines[order[1:]] == lines[order[:-1]]]] = True

    # the last byte of each worded line that is not white space
    last = ends[np.maximum(np.searchsorted(starts, le) - 1, 0)] - 1 if len(starts) else np.zeros(len(ls), np.int64)
    letters = np.r_[0, np.cumsum(LETTER[data])]
    return {
        "n_words": np.diff(first).astype(np.int64),
        "word_chars": _sums(~space & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _sums(SYMBOL[data], offsets),
        "n_dup_lines": _sums(again, lfirst),
        "n_repeat_words": _sums(covered, first),
        "n_lines": _sums(worded, lfirst),
        "n_stop_lines": _sums(worded & STOP[data[last]], lfirst) if len(ls) and len(starts) else np.zeros(n, np.int64),
        "n_letter_words": _sums(letters[ends] > letters[starts], first),
    }


def _measurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in textkit.pieces(batches):
        found = measure(data, offsets)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[k]) for k in STATS)], ["row", *STATS])


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """Each rule's vote; a rule without anything to look at abstains."""
    n, lines = F.col("n_words"), F.col("n_lines")
    mean = F.try_divide("word_chars", n)
    some = lambda x: F.coalesce(x, F.lit(False))
    return {
        "length": _vote(n >= 100, n < 50),
        "word_length": _vote(some(mean.between(3, 9)), some((mean < 2.5) | (mean > 12))),
        "symbols": _vote((n > 0) & (F.col("n_symbols") * 50 <= n), F.col("n_symbols") * 10 > n),
        "symbol_share": _vote((n > 0) & (F.col("n_symbols") * 200 <= F.col("word_chars")), F.col("n_symbols") * 40 > F.col("word_chars")),
        "dup_lines": _vote((lines >= 3) & (F.col("n_dup_lines") == 0), F.col("n_dup_lines") * 2 > lines),
        "repeats": _vote((n >= 20) & (F.col("n_repeat_words") * 10 <= n), F.col("n_repeat_words") * 10 > n * 3),
        "sentences": _vote((lines > 0) & (F.col("n_stop_lines") * 10 >= lines * 6), (lines >= 3) & (F.col("n_stop_lines") * 10 < lines)),
        "letters": _vote((n > 0) & (F.col("n_letter_words") * 10 >= n * 9), F.col("n_letter_words") * 10 < n * 6),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each vote pattern, and each rule's chance to vote good, given that it votes, on (bad, good) texts.

    EM starts from the opinion that a text some rule objects to is probably bad. Abstentions carry no evidence. Each
    rule's chances have a weak Beta prior (rules mostly object to bad texts), and a rule may not prefer bad texts to good ones.
    """
    if not len(patterns):
        return np.zeros(0), np.zeros((0, 2))
    n = counts.astype(float)
    up, down = (patterns == 1).astype(float), (patterns == -1).astype(float)  # pattern, rule
    good = np.where(down.any(axis=1), 0.05, 0.95)
    prior_votes = np.array([[2.0, 2.0], [9.0, 0.1]])  # good and bad votes added for (bad, good) texts
    for _ in range(rounds):
        weight = np.stack([n * (1 - good), n * good])  # class, pattern
        share = (weight.sum(axis=1) + 1) / (n.sum() + 2)
        ups, downs = weight @ up + prior_votes[:, :1], weight @ down + prior_votes[:, 1:]
        says_good = (ups / (ups + downs)).T  # rule, class
        says_good[:, 0] = np.minimum(says_good[:, 0], says_good[:, 1])
        odds = np.log(share[1] / share[0]) + up @ np.log(says_good[:, 1] / says_good[:, 0]) + down @ np.log((1 - says_good[:, 1]) / (1 - says_good[:, 0]))
        fresh = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        moved, good = np.abs(fresh - good).max(), fresh
        if moved < 1e-9:
            break
    return good, says_good


def judge(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Rows (row, statistics, votes, base_failed, posterior, kept): the input row without its text as a struct and the verdict on it.

    A null or empty text has no words and fails the base. An empty table gives an empty result. Input columns stay inside
    ``row``, so their names cannot clash. Equal rows are judged, and counted, each on its own, and alike. Very long texts are measured whole. A posterior of one half is kept.
    """
    spark = docs.sparkSession
    rows = apart(docs, text_col)
    shape = rows.select("row", *(F.lit(0).cast("long").alias(k) for k in STATS)).schema
    found = settle(rows.mapInArrow(_measurer, shape), "quality-stats")
    rules = votes()
    key = sum(((F.col(f"vote_{k}") + 1) * 3**i for i, k in enumerate(rules)), F.lit(0)).cast("int")
    found = found.select("*", *(v.alias(f"vote_{k}") for k, v in rules.items())).withColumn("pattern", key)
    seen = found.groupBy("pattern").count().orderBy("pattern").toPandas()
    codes = seen["pattern"].to_numpy(np.int64)
    patterns = np.stack([codes // 3**i % 3 - 1 for i in range(len(rules))], axis=1) if len(codes) else np.zeros((0, len(rules)))
    good, _ = estimate(patterns, seen["count"].to_numpy(np.int64))
    table = spark.createDataFrame([(int(c), float(g)) for c, g in zip(codes, good, strict=True)], "pattern int, posterior double")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    found = found.join(F.broadcast(table), "pattern").drop("pattern").withColumn("base_failed", failed)
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = judge(docs.select("doc_id", "text"))
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
