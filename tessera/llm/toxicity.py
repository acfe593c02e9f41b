"""Toxicity by class-conditional Kneser-Ney models.

Each class has a model of how words are spelled: every byte of a word, and its end, given the ``order - 1`` symbols before it in the word, whose start is a symbol too.
A class's counts are discounted absolutely and what the discount frees backs off to shorter contexts. Their model is shared by the classes: interpolated Kneser-Ney, in
which an event counts once for each symbol that stands before it. A whole event seen in neither class weighs nothing either way.
A word's evidence is its log-likelihood under the toxic model less that under the ordinary one; a text's is the mean over its words of
the evidence above ``margin``, which a few insults in a long text still move and thousands of ordinary words do not.

Counts are taken over all labelled rows. Words, events and contexts are rows of tables that grow with the corpus. Only words that may have evidence above the margin are sent to meet the
events, and texts meet only the words that have it: broadcast tables of fixed size pass over the others, and the joins that follow are exact. The table for words holds the evidence of each
event, by its hash; events that share a slot count there as the largest of them, so a word's sum is never too small, and with more events than slots more words are sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkit
from tessera.llm.decontam import WORD
from tessera.llm.durable import apart, drop, settle

ORDER = 5
#: Bytes of a run that count as one word.
STRETCH = 24
DISCOUNT: float | None = 2.0
MARGIN = 2.0
SLOT_BITS = 21
FLOOR = 0.01
BINS = 512
#: Slots of the table of events that bounds a word's evidence.
EVENT_BITS = 21
#: Symbols that stand before and after a word; no word has them.
START, END = 1, 2
#: Slots of a map of labelled ids.
ID_SLOTS = 1 << 19
#: Different stretches that a task remembers at once.
GIVEN = 2_000_000
#: Discount of the shared model; evidence is kept in whole numbers of 1 / UNIT nats, so that sums do not depend on their order.
SHARED_DISCOUNT, UNIT = 0.75, 1 << 20
_RANGE = (np.log(FLOOR), np.log(40.0))


def stretches(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index of each text's first stretch; of each stretch its identity, where it begins with its context and ends, how many bytes are context, and whether its word ends there.

    A word is one stretch, a run of more than ``STRETCH`` bytes several: text without spaces has words of its own in this way. The bytes before a later one are its context.
    """
    starts, ends, first = textkit.runs(WORD[data], offsets)
    parts = -(-(ends - starts) // STRETCH)
    base = np.concatenate([[0], np.cumsum(parts)])
    word = np.repeat(np.arange(len(starts)), parts)
    number = np.arange(base[-1]) - base[word]
    lo = starts[word] + number * STRETCH
    hi = np.minimum(lo + STRETCH, ends[word])
    skip, closes = np.where(number > 0, order - 1, 0), hi == ends[word]
    lo = lo - skip
    name = textkit.mixed(textkit.Prefix(data, lower=True)(lo, hi) + (2 * skip + closes + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return base[first], name.view(np.int64), lo, hi, skip, closes


def _vocabulary(order: int, once: bool = False):
    """For mapInArrow over (group, text): different stretches with their counts by group 0 to 3, twice the fold plus the class; other groups count nothing.

    ``once``, for texts that count nothing: what a task has given lately it does not give again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = np.zeros(0, np.int64)
        for batch, data, offsets in textkit.pieces(batches):
            first, name, lo, hi, skip, closes = stretches(data, offsets, order)
            group = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(first))
            names, at, place = np.unique(name, return_index=True, return_inverse=True)
            counts = [np.bincount(place[group == g], minlength=len(names)).astype(np.int64) for g in range(4)]
            if once:
                spot = np.minimum(np.searchsorted(given, names), max(len(given) - 1, 0))
                new = given[spot] != names if len(given) else np.ones(len(names), bool)
                names, at, counts = names[new], at[new], [c[new] for c in counts]
                given = np.union1d(given, names) if len(given) < GIVEN else names
            lower = textkit.LOWER[data].tobytes()
            words = [lower[a:b] for a, b in zip(lo[at].tolist(), hi[at].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(words, pa.binary()), pa.array(skip[at].astype(np.int32)), pa.array(closes[at]), *map(pa.array, counts)], ["name", "word", "skip", "closes", "g0", "g1", "g2", "g3"])

    return run


def _spelled(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each event of words with columns (name, word, skip, closes): its word's row, its last ``order`` symbols and which of these the word has."""
    n, skip, closes = batch.num_rows, batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
    opens = (skip == 0).astype(np.int64)
    size = np.diff(offsets)
    ends = np.cumsum(size + opens + closes)
    starts = np.r_[0, ends[:-1]]
    symbols = np.full(int(ends[-1]) if n else 0, END, np.uint8)  # what no word fills is an end, or
    symbols[starts[opens > 0]] = START
    row = np.repeat(np.arange(n), size)
    symbols[np.arange(len(data)) + (starts + opens - offsets[:-1])[row]] = data
    owner = np.repeat(np.arange(n), ends - starts)
    at = np.flatnonzero(np.arange(len(symbols)) >= (starts + np.where(opens > 0, 1, skip))[owner])
    own = owner[at]
    spots = at[:, None] - np.arange(order - 1, -1, -1)[None, :]
    return own, symbols[np.maximum(spots, 0)], spots >= starts[own][:, None]


def _as_binary(symbols: np.ndarray, inside: np.ndarray) -> pa.Array:
    """The symbols that are inside, a row each."""
    bounds = np.r_[0, np.cumsum(inside.sum(axis=1))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(symbols), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(symbols[inside].tobytes())])


def _hashed(symbols: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """A hash of each row's symbols, alike for equal ones; different ones of up to 7 symbols never meet."""
    value = np.zeros(len(symbols), np.uint64)
    for j in range(symbols.shape[1]):
        value = value * np.uint64(257) + np.where(inside[:, j], symbols[:, j].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return textkit.mixed(value)


def _speller(order: int):
    """For mapInArrow over (name, word, skip, closes, g0 to g3): a row for each event: its symbol with the symbols before it, ``order`` at most, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in textkit.pieces(batches, most=1 << 17):
            own, symbols, inside = _spelled(batch, data, offsets, order)
            taken = pa.array(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), _as_binary(symbols, inside), *(batch.column(i).take(taken) for i in range(4, 8))], ["name", "gram", "g0", "g1", "g2", "g3"])

    return run


def _event_hashes(order: int):
    """For mapInArrow over (e0, gram, e1): (h, e0, e1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in textkit.pieces(batches, most=1 << 17):
            size = np.diff(offsets)
            inside = np.arange(order)[None, :] >= (order - size)[:, None]
            symbols = np.zeros(inside.shape, np.uint8)
            symbols[inside] = data
            yield pa.RecordBatch.from_arrays([pa.array(_hashed(symbols, inside).view(np.int64)), batch.column(0), batch.column(2)], ["h", "e0", "e1"])

    return run


def event_slots(known: DataFrame, order: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of 2**bits slots, by the first bits of an event's hash: the hash of the only event there, whether there are several, and e0 and e1, of several the largest or 0."""
    hashed = known.select("e0", "gram", "e1").mapInArrow(_event_hashes(order), "h long, e0 long, e1 long")
    rows = hashed.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("slot")).agg(F.max("h").alias("h"), (F.count("*") > 1).alias("many"), F.max("e0").alias("e0"), F.max("e1").alias("e1")).toArrow()
    slot, many = rows.column("slot").to_numpy(), rows.column("many").to_numpy()
    hashes, several, most = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, bool), np.zeros((2, 1 << bits), np.int32)
    hashes[slot], several[slot] = rows.column("h").to_numpy(), many
    for i in range(2):
        e = rows.column(f"e{i}").to_numpy()
        most[i, slot] = np.where(many, np.maximum(e, 0), e)
    return hashes, several, most


def _sieve(sent, order: int, bits: int, least: int):
    """For mapInArrow over (name, word, skip, closes): (name, gram) of the events of words whose evidence may be above ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, several, most = sent.value
        for batch, data, offsets in textkit.pieces(batches, most=1 << 17):
            own, symbols, inside = _spelled(batch, data, offsets, order)
            h = _hashed(symbols, inside)
            slot = (h >> np.uint64(64 - bits)).astype(np.int64)
            found = several[slot] | (hashes[slot] == h.view(np.int64))
            sums = [np.bincount(own[found], weights=e[slot[found]], minlength=batch.num_rows) for e in most]
            wanted = (np.maximum(*sums) > least)[own]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own[wanted])), _as_binary(symbols[wanted], inside[wanted])], ["name", "gram"])

    return run


def _context(gram: str) -> Column:
    return F.substring(gram, F.lit(1), F.octet_length(gram) - 1)


def _shorter(gram: str) -> Column:
    """All that is left of an event as its first symbols are taken away, the longest first."""
    return F.transform(F.sequence(F.lit(2), F.octet_length(gram)), lambda i: F.substring(F.col(gram), i, F.octet_length(gram)))


def discounts(counts: DataFrame, names: tuple[str, ...]) -> dict[str, float]:
    """Absolute discounts n1 / (n1 + 2 n2) of count columns, n1 and n2 being how many events are seen once and twice; 0.75 where none is."""
    seen = counts.agg(*(F.count_if(F.col(c) == n).alias(f"{c}_{n}") for c in names for n in (1, 2))).first()
    return {c: seen[f"{c}_1"] / (seen[f"{c}_1"] + 2 * seen[f"{c}_2"]) if seen[f"{c}_1"] else SHARED_DISCOUNT for c in names}


def evidence(events: DataFrame, discount: float | None) -> DataFrame:
    """(gram, e0, e1): log-likelihood ratio of each event of the labelled rows, toxic over ordinary, in units of 1 / ``UNIT``; e0 of fold 0 alone, e1 of all.

    ``discount`` is what each class takes from a count; None stands for the estimate of ``discounts``.
    """
    tops = settle(events.filter("g0 + g1 + g2 + g3 > 0").groupBy("gram").agg(*(F.sum(f"g{i}").alias(f"g{i}") for i in range(4))), "toxicity-events")

    # the shared model: how many different events one symbol longer end in this one
    longer = tops.select(F.explode(F.concat(F.array("gram"), F.when(F.octet_length("gram") > 1, _shorter("gram")).otherwise(F.array()))).alias("l")).filter(F.octet_length("l") > 1).distinct()
    lower = longer.groupBy(F.substring("l", F.lit(2), F.octet_length("l")).alias("s")).agg(F.count("*").alias("n")).withColumn("c", _context("s"))
    spread = lower.groupBy(F.col("c").alias("d")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    lower = lower.join(spread.hint("shuffle_merge"), F.col("c") == F.col("d")).select("s", "n", "total", "kinds")
    steps = tops.filter(F.octet_length("gram") > 1).select("gram", F.explode(_shorter("gram")).alias("t"))
    levels = steps.join(lower.hint("shuffle_merge"), F.col("t") == F.col("s")).groupBy("gram").agg(F.array_sort(F.collect_list(F.struct(F.octet_length("t").alias("level"), "n", "total", "kinds"))).alias("levels"))
    shared = F.aggregate("levels", F.lit(1 / 257), lambda p, x: (x["n"] - F.lit(SHARED_DISCOUNT) + F.lit(SHARED_DISCOUNT) * x["kinds"] * p) / x["total"])
    names = ("a0", "a1", "b0", "b1")
    found = tops.select("gram", _context("gram").alias("context"), F.col("g0").alias("a0"), F.col("g1").alias("a1"), (F.col("g0") + F.col("g2")).alias("b0"), (F.col("g1") + F.col("g3")).alias("b1"))
    less = discounts(found, names) if discount is None else dict.fromkeys(names, discount)
    totals = found.groupBy(F.col("context").alias("d")).agg(*(F.sum(c).alias(f"{c}_total") for c in names), *(F.sum(F.least(F.col(c).cast("double"), F.lit(less[c]))).alias(f"{c}_freed") for c in names))
    found = found.join(totals.hint("shuffle_merge"), F.col("context") == F.col("d")).join(levels.select(F.col("gram").alias("t"), shared.alias("shared")).hint("shuffle_merge"), F.col("gram") == F.col("t"))

    def log_of(c: str) -> Column:
        p = (F.greatest(F.col(c) - F.lit(less[c]), F.lit(0.0)) + F.col(f"{c}_freed") * F.col("shared")) / F.greatest(F.col(f"{c}_total"), F.lit(1))
        return F.log(F.when(F.col(f"{c}_total") > 0, F.greatest(p, F.lit(1e-12))).otherwise(F.col("shared")))

    ratio = lambda c: F.when(F.col(f"{c}0") + F.col(f"{c}1") > 0, F.round((log_of(f"{c}1") - log_of(f"{c}0")) * UNIT)).otherwise(F.lit(0)).cast("long")
    found = settle(found.select("gram", ratio("a").alias("e0"), ratio("b").alias("e1")), "toxicity-evidence")
    drop(tops)
    return found


def _finder(sent, order: int, bits: int):
    """For mapInArrow over (row, text): the number of stretches of each text and those that may have evidence above the margin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = sent.value
        for batch, data, offsets in textkit.pieces(batches):
            first, name, *_ = stretches(data, offsets, order)
            hit = np.flatnonzero(marked[(name.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)])
            hits = pa.ListArray.from_arrays(pa.array(np.searchsorted(hit, first).astype(np.int32)), pa.array(name[hit]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), hits], ["row", "n", "hits"])

    return run


def _measured(rows: DataFrame, weights: DataFrame, weight: str, sent, order: int, bits: int) -> DataFrame:
    """(row, x) for (row, text): logarithm of the mean evidence above the margin of each text's words; that of 0 without words."""
    shape = rows.select("row", F.lit(0).cast("long").alias("n"), F.array(F.lit(0).cast("long")).alias("hits")).schema
    found = settle(rows.mapInArrow(_finder(sent, order, bits), shape).withColumn("id", F.monotonically_increasing_id()), "toxicity-hits")
    sums = found.select("id", F.explode("hits").alias("name")).join(weights.select("name", weight).hint("shuffle_merge"), "name").groupBy(F.col("id").alias("i")).agg(F.sum(weight).alias("total"))
    mean = F.coalesce("total", F.lit(0)) / F.lit(UNIT) / F.greatest("n", F.lit(1))
    return found.join(sums.hint("shuffle_merge"), F.col("id") == F.col("i"), "left").select("row", F.log(mean + F.lit(FLOOR)).alias("x"))


def calibrate(x: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> tuple[float, float]:
    """Slope (0 or more) and intercept of a logistic curve through binned counts, by Newton steps with a little ridge."""
    a, b = 1.0, 0.0
    n = ones + zeros
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        grad = np.array([((ones - n * p) * x).sum() - 1e-2 * a, (ones - n * p).sum() - 1e-3 * b])
        hess = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 0.0), float(b)


def _may_be_among(rows: DataFrame, column: str) -> Column:
    """Whether a value's slot of ``ID_SLOTS`` is taken by some row: false only for values that no row has. The map is a literal of one byte a slot."""
    slot = F.pmod(F.xxhash64(column), F.lit(ID_SLOTS))
    taken = np.zeros(ID_SLOTS, np.uint8)
    taken[rows.select(slot.alias("slot")).distinct().toArrow().column("slot").to_numpy()] = 1
    return F.substring(F.lit(taken.tobytes()), slot.cast("int") + 1, F.lit(1)) != F.lit(b"\x00")


def score(
    docs: DataFrame, labels: DataFrame, fold: Column, *, order: int = ORDER, discount: float | None = DISCOUNT, margin: float = MARGIN, bits: int = SLOT_BITS,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> DataFrame:
    """Rows (row, score) for every row of ``docs``: the input row without its text as a struct and the chance of label 1.

    ``fold`` (over the input columns) is null for rows not to learn from, 1 for those that set the score curve, 0 for other rows to learn from; the final counts
    are of both. Labels other than 0 and 1, labelled ids without a document and null texts teach nothing; repeated labels count each time.
    Null and empty texts, and those without words, score as a text without evidence. Without labels of both classes every score is the share of label 1 (0 without labels).
    Very long texts are read whole; equal texts score alike, repeated rows have a row each; input columns stay inside ``row``, so their names cannot clash; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    taught = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), fold.alias("_fold")).filter("_fold IS NOT NULL AND text IS NOT NULL")
    # the same plan at every size: labels grow with the corpus, so they are never broadcast; a map of fixed size spares most texts without a label the shuffle
    taught = taught.filter(_may_be_among(known, "_id"))
    taught = settle(taught.join(known.hint("shuffle_merge"), "_id").select((F.col("_fold") * 2 + F.col("_label")).cast("long").alias("g"), "text"), "toxicity-taught")
    numbers = {r["g"]: r["count"] for r in taught.groupBy("g").count().collect()}
    ones, everyone = sum(n for g, n in numbers.items() if g % 2), sum(numbers.values())
    rows = apart(docs, text_col)
    if not 0 < ones < everyone:
        return rows.select("row", F.lit(ones / everyone if everyone else 0.0).alias("score"))
    shape = "name long, word binary, skip int, closes boolean, g0 long, g1 long, g2 long, g3 long"
    words = taught.mapInArrow(_vocabulary(order), shape).union(docs.select(F.lit(-1).cast("long").alias("g"), F.col(text_col).alias("text")).mapInArrow(_vocabulary(order, once=True), shape))
    words = settle(words.groupBy("name", "word", "skip", "closes").agg(*(F.sum(f"g{i}").alias(f"g{i}") for i in range(4))), "toxicity-words")
    events = words.mapInArrow(_speller(order), "name long, gram binary, g0 long, g1 long, g2 long, g3 long")
    known = evidence(events, discount)
    telling = known.filter("e0 <> 0 OR e1 <> 0")
    bound = spark.sparkContext.broadcast(event_slots(telling, order, EVENT_BITS))
    events = words.select("name", "word", "skip", "closes").mapInArrow(_sieve(bound, order, EVENT_BITS, round(margin * UNIT)), "name long, gram binary")
    sums = events.join(telling.hint("shuffle_merge"), "gram").groupBy("name").agg(F.sum("e0").alias("e0"), F.sum("e1").alias("e1"))
    above = [F.greatest(F.col(f"e{i}") - F.lit(round(margin * UNIT)), F.lit(0)).cast("long").alias(f"w{i}") for i in range(2)]
    weights = settle(sums.select("name", *above).filter("w0 > 0 OR w1 > 0"), "toxicity-weights")
    drop(words, known)
    slots = weights.select(F.shiftrightunsigned("name", 64 - bits).alias("slot")).distinct().toArrow().column("slot").to_numpy()
    marked = np.zeros(1 << bits, bool)
    marked[slots] = True
    sent = spark.sparkContext.broadcast(marked)

    if all(numbers.get(g) for g in range(4)):
        measured = _measured(taught.filter("g >= 2").select(F.col("g").alias("row"), "text"), weights, "w0", sent, order, bits)
        place = F.least(F.greatest(F.floor((F.col("x") - _RANGE[0]) / (_RANGE[1] - _RANGE[0]) * BINS), F.lit(0)), F.lit(BINS - 1))
        bins = measured.groupBy(place.alias("bin")).agg(F.sum(F.col("row") - 2).alias("ones"), F.count("*").alias("n")).orderBy("bin").toPandas()
        x = _RANGE[0] + (bins["bin"].to_numpy(float) + 0.5) / BINS * (_RANGE[1] - _RANGE[0])
        a, b = calibrate(x, bins["ones"].to_numpy(float), (bins["n"] - bins["ones"]).to_numpy(float))
    else:  # too few labels to fit the curve: even odds where the mean word shows a tenth of a nat
        a, b = 2.0, -2.0 * float(np.log(0.1 + FLOOR))
    scored = _measured(rows, weights, "w1", sent, order, bits)
    return scored.select("row", (F.lit(1.0) / (1 + F.exp(-(F.lit(a) * F.col("x") + F.lit(b))))).alias("score"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    left = F.crc32(F.col("doc_id").cast("string")) % 5
    found = score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.when(left != 0, (left == 1).cast("int")))
    held = F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 5 == 0, F.lit(True))
    return found.select("row.doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLES: dict[str, str] = {}
