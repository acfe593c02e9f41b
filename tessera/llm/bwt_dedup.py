"""Suffix-array dedup: every byte under a string of ``length`` bytes that also starts elsewhere in the corpus.

Strings are dealt to tasks by minimizer: the windows of ``length`` bytes whose least k-gram hash stands at one place form a run, equal windows
have equal least k-grams at equal offsets, and so meet under one key. Runs that are alone under their key are unique. Equal runs are repeats as a whole, and one of them
stands for all. The runs that remain different are fetched from their texts, and a task builds the Burrows-Wheeler
transform of those it was dealt. Interval expansion then derives common prefixes by increasing value: the intervals of all strings of l bytes,
extended backward by every byte before them, give the places in suffix order where neighbours share exactly l bytes. It stops at ``length``:
neighbours still undivided share at least that much.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkit
from tessera.llm.durable import apart, drop, settle

LENGTH = 200
#: Bytes that one transform covers; more under one key go the way of ``_by_window``.
BATCH_BYTES = 2_000_000
#: Ends each string in a transform; no UTF-8 text has it.
END = 0xFF
_LOW = 21


def _gram(length: int) -> int:
    return max(1, min(24, length // 3))


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w successive numbers."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: text, first window start in it, number of windows, key, hash of all its bytes, hashes of its flanks.

    A window reaches at least half of what the minimizer leaves over to one side of it, so runs that share a window share one of the two flanks.
    """
    n, k = len(data), _gram(length)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    prefix = textkit.Prefix(data)
    grams = textkit.mixed((prefix.sums[k:] - prefix.sums[:-k]) * prefix.down[: n - k + 1])
    low = np.uint64((1 << _LOW) - 1)
    least = _sliding_least((grams & ~low) | (np.arange(n - k + 1, dtype=np.uint64) & low), length - k + 1)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(owner[: n - length + 1] == owner[length - 1 :])
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    least = least[at]
    new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)])
    start, stop, least = at[new], at[np.r_[new[1:] - 1, len(at) - 1]] + 1, least[new]
    place = (start & ~((1 << _LOW) - 1)) | (least & low).astype(np.int64)
    place = np.where(place < start, place + (1 << _LOW), place)
    half = (length - k) // 2
    left = np.where(place - half >= start, prefix(np.maximum(place - half, 0), place), np.uint64(0))
    right = np.where(place + k + half <= stop + length - 1, prefix(np.minimum(place + k, n), np.minimum(place + k + half, n)), np.uint64(0))
    flanks = (left >> np.uint64(32) << np.uint64(32)) | (right >> np.uint64(32))
    text = owner[start]
    return text, start - offsets[text], stop - start, least >> np.uint64(_LOW), prefix(start, stop + length - 1), flanks


def _runner(length: int):
    """For mapInArrow over (r, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in textkit.pieces(batches):
            text, start, count, key, whole, flanks = window_runs(data, offsets, length)
            rows = np.asarray(batch.column(0))[text]
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(whole.view(np.int64)), pa.array(flanks.view(np.int64)), pa.array(rows), pa.array(start << 16 | count)], ["key", "f", "flanks", "r", "span"])

    return run


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix starts in order of their first ``depth`` bytes (at least), by doubling; numbers of 64 bits are sorted with their places."""
    n = len(text)
    bits = np.uint64(max(1, int(n).bit_length()))
    assert int(bits) <= 22, "a transform covers at most 4 MB"
    mask = np.uint64((1 << int(bits)) - 1)
    place = np.arange(n, dtype=np.uint64)
    padded = np.r_[text, np.full(5, END, np.uint8)]
    packed = np.zeros(n, np.uint64)
    have = 5
    for j in range(have):
        packed = packed << np.uint64(8) | padded[j : n + j]
    packed = np.sort(packed << bits | place)
    while True:
        order = (packed & mask).astype(np.int64)
        head = packed >> bits
        rank = np.empty(n, np.uint64)
        numbers = np.cumsum(np.r_[False, head[1:] != head[:-1]])
        rank[order] = numbers.astype(np.uint64)
        if have >= depth or (n and numbers[-1] == n - 1):
            return order
        after = np.zeros(n, np.uint64)
        after[: max(0, n - have)] = rank[have:] + np.uint64(1) if have < n else 0
        # rank, rank after, place: three numbers below 2**21 (or 2**22, of which ranks take one step each)
        packed = np.sort(((rank << bits | after) << bits | place)) if int(bits) * 3 <= 64 else _wide(rank, after, place, bits)
        have *= 2


def _wide(rank: np.ndarray, after: np.ndarray, place: np.ndarray, bits: np.uint64) -> np.ndarray:
    """As the sort in ``suffix_order`` where three numbers do not fit: ranks of the pairs, then their places."""
    pair = rank << np.uint64(32) | after
    ordered = np.sort(pair)
    return np.sort(np.searchsorted(ordered, pair).astype(np.uint64) << bits | place)


def undivided(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in suffix order, whether the suffix there shares its first ``length`` bytes with the one before it.

    Breadth-first backward extension: an interval [a, b) of the order holds the suffixes that start with some string w. The
    bytes before them, the transform over [a, b), split it into the intervals of cw, whose ends are the last occurrence of c mapped by LF.
    If no shorter string has marked the end of cw, suffixes on its two sides share exactly |w| bytes, and cw is expanded next.
    """
    n = len(text)
    before = text[order - 1]  # the text ends with END, so the first suffix wraps to that
    by_byte = np.argsort(before, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_byte] = np.arange(n)
    same = before[by_byte][1:] == before[by_byte][:-1]
    following, preceding = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    following[by_byte[:-1][same]] = by_byte[1:][same]
    preceding[by_byte[1:][same]] = by_byte[:-1][same]
    divided = np.zeros(n + 1, bool)
    divided[[0, n]] = True
    a, b = np.array([0]), np.array([n])
    for _ in range(length):
        size = b - a
        inside = np.arange(size.sum()) + np.repeat(a - np.r_[0, np.cumsum(size)[:-1]], size)
        first = inside[preceding[inside] < np.repeat(a, size)]
        last = inside[following[inside] >= np.repeat(b, size)]
        starts, ends = np.sort(lf[first]), np.sort(lf[last]) + 1
        fresh = ~divided[ends]
        a, b = starts[fresh], ends[fresh]
        divided[b] = True
        if not len(a):
            break
    return ~divided[:n]


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, which window starts hold a window that starts elsewhere in the strings too."""
    text = np.frombuffer(bytes([END]).join([*strings, b""]), np.uint8)
    order = suffix_order(text, length)
    linked = undivided(text, order, length)
    linked[:-1] |= linked[1:]
    marks = np.zeros(len(text), bool)
    marks[order[linked]] = True
    bounds = np.r_[0, np.cumsum([len(s) + 1 for s in strings])]
    return [marks[x : x + max(0, len(s) - length + 1)] for x, s in zip(bounds, strings, strict=False)]


def _ranges(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[False, marks, False]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_RUN_SHAPE = "key long, f long, s long, e long, large binary"


def _expander(length: int, most: int):
    """For mapInArrow over (key, f, body) sorted so: ranges (s, e) of repeated window starts; bodies of keys that are too large for one transform."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        held: list[tuple[int, int, bytes]] = []
        own: list[tuple[int, int, bytes]] = []
        state = {"held": 0, "own": 0, "large": False}

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            if len(done) > least:
                columns = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.binary()], strict=True)], ["key", "f", "s", "e", "large"])
                done.clear()

        def transform() -> None:
            if len(held) > 1:
                for (key, f, _), marks in zip(held, repeated_starts([h[2] for h in held], length), strict=True):
                    done.extend((key, f, s, e, None) for s, e in _ranges(marks))
            held.clear()
            state["held"] = 0

        def close() -> None:
            if state["large"]:
                done.extend((key, f, None, None, body) for key, f, body in own)
            elif len(own) > 1:
                if state["held"] + state["own"] > most:
                    transform()
                held.extend(own)
                state["held"] += state["own"]
            own.clear()
            state["own"] = 0

        key = f = None
        for batch in batches:
            for k, g, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    close()
                    key, f, state["large"] = k, None, False
                if g == f:  # the run of a row that stands in the table twice
                    continue
                f = g
                own.append((k, g, body))
                state["own"] += len(body) + 1
                if state["own"] > most:
                    state["large"] = True
                    done.extend((*o[:2], None, None, o[2]) for o in own)
                    own.clear()
                    state["own"] = 0
                    yield from flush(1000)
            yield from flush(20_000)
        close()
        transform()
        yield from flush(0)

    return expand


def _window_hasher(length: int):
    """For mapInArrow over (key, f, large): every window with its hash and a second one."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in textkit.pieces(batches, text=2, most=1 << 18):
            at = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            owner = np.searchsorted(offsets, at, "right") - 1
            one = textkit.Prefix(data)(at, at + length)
            two = textkit.Prefix(data[::-1])(len(data) - at - length, len(data) - at)
            keys, fs = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(keys[owner]), pa.array(fs[owner]), pa.array(at - offsets[owner]), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["key", "f", "s", "one", "two"])

    return explode


def _by_window(large: DataFrame, length: int) -> DataFrame:
    """Repeated windows of runs under a key with too many different runs for one transform: dealt once more, by the whole window."""
    windows = large.select("key", "f", "large").mapInArrow(_window_hasher(length), "key long, f long, s long, one long, two long")
    twice = windows.groupBy("key", "one", "two").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("k"), F.col("one").alias("o"), F.col("two").alias("t"))
    found = windows.join(twice.hint("shuffle_merge"), (F.col("key") == F.col("k")) & (F.col("one") == F.col("o")) & (F.col("two") == F.col("t")))
    return found.select("key", "f", "s", (F.col("s") + 1).alias("e"))


def _cutter(length: int):
    """For mapInArrow over (key, f, span, text): the bytes of each run."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in textkit.pieces(batches, text=1):
            runs = batch.column(0).to_pylist()
            out = []
            for a, b, own in zip(offsets[:-1].tolist(), offsets[1:].tolist(), runs, strict=True):
                for x in own:
                    s = a + (x["span"] >> 16)
                    out.append((x["key"], x["f"], data[s : min(b, s + (x["span"] & 0xFFFF) + length - 1)].tobytes()))
            keys, fs, bodies = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fs, pa.int64()), pa.array(bodies, pa.binary())], ["key", "f", "body"])

    return cut


def repeats(texts: DataFrame, length: int, batch_bytes: int) -> DataFrame:
    """(r, start, stop): byte ranges of the texts (r, text) that repeated windows cover; ranges may overlap."""
    runs = texts.filter(F.octet_length("text") >= length).mapInArrow(_runner(length), "key long, f long, flanks long, r long, span long")
    # counted by partial sums: equal runs, and one of each with how many there are
    ones = settle(runs.groupBy("key", "f").agg(F.count("*").alias("n"), F.min(F.struct("r", "span", "flanks")).alias("one")), "runs")
    twice = settle(ones.filter("n > 1").select(F.col("key").alias("k"), F.col("f").alias("g")), "equal-runs")
    others = ones.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("m")).filter("m > 1").select("k")
    different = settle(ones.join(others.hint("shuffle_merge"), F.col("key") == F.col("k")).select("key", "f", "n", "one.*"), "different-runs")
    drop(ones)

    # of different runs under one key, those that have a flank of another
    flank = F.explode(F.array(F.shiftright("flanks", 32) * 2, F.col("flanks").bitwiseAND(0xFFFFFFFF) * 2 + 1)).alias("flank")
    sides = different.select("key", "f", "flanks", "r", "span", flank).filter("flank NOT IN (0, 1)")
    shared = sides.groupBy("key", "flank").agg(F.min("f").alias("low"), F.max("f").alias("high")).filter("low <> high")
    shared = shared.select(F.col("key").alias("k"), F.col("flank").alias("l"))
    asked = sides.join(shared.hint("shuffle_merge"), (F.col("key") == F.col("k")) & (F.col("flank") == F.col("l"))).select("r", "key", "f", "span").distinct()
    asked = asked.groupBy("r").agg(F.collect_list(F.struct("key", "f", "span")).alias("runs")).withColumnRenamed("r", "q")
    bodies = texts.join(asked.hint("shuffle_merge"), F.col("r") == F.col("q")).select("runs", "text").mapInArrow(_cutter(length), "key long, f long, body binary")
    bodies = bodies.repartition("key").sortWithinPartitions("key", "f")
    found = settle(bodies.mapInArrow(_expander(length, batch_bytes), _RUN_SHAPE), "repeated-runs")
    ranges = found.filter("large IS NULL").select("key", "f", "s", "e")
    if (large := found.filter("large IS NOT NULL")).head(1):
        ranges = ranges.union(_by_window(large, length))

    start, count = F.shiftright("span", 16), F.col("span").bitwiseAND(0xFFFF)
    same = runs.join(twice.hint("shuffle_merge"), (F.col("key") == F.col("k")) & (F.col("f") == F.col("g")))
    whole = same.select("r", start.alias("start"), (start + count + (length - 1)).alias("stop"))
    ranges = ranges.withColumnsRenamed({"key": "k", "f": "g"})
    parts = different.filter("n = 1").join(ranges.hint("shuffle_merge"), (F.col("key") == F.col("k")) & (F.col("f") == F.col("g")))
    parts = parts.select("r", (start + F.col("s")).alias("start"), (start + F.col("e") + (length - 1)).alias("stop"))
    merged = settle(whole.union(parts).distinct(), "repeated-ranges")
    drop(twice, different, found)
    return merged


def _keeper(keep: bool):
    """For mapInArrow over (row, text, ranges)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in textkit.pieces(batches):
            n_bytes, n_removed, n_spans, digests, kept = np.diff(offsets), [], [], [], []
            for a, b, ranges in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column(2).to_pylist(), strict=True):
                body = data[a:b]
                spans = 0
                if ranges:
                    edge = np.zeros(b - a + 1, np.int64)
                    np.add.at(edge, [x["start"] for x in ranges], 1)
                    np.add.at(edge, [x["stop"] for x in ranges], -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                    body = body[~covered]
                body = body.tobytes()
                n_removed.append(b - a - len(body))
                n_spans.append(spans)
                digests.append(hashlib.sha256(body).hexdigest())
                kept.append(body.decode("utf-8", "ignore") if keep else None)
            out = {"row": batch.column(0), "text": pa.array(kept, pa.string(), mask=np.asarray(batch.column(1).is_null())), "n_bytes": pa.array(n_bytes), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    return work


def dedup(docs: DataFrame, *, length: int = LENGTH, text_col: str = "text", keep_text: bool = False, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Rows (row, text, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``: the input row without its text as a struct, what is left of the text
    (null unless ``keep_text``; characters that lose some of their bytes go), and figures of the bytes.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in this text or another; all copies go. Null is as empty, and null texts stay null.
    Texts shorter than ``length`` keep everything. Rows that are equal in all columns count as two texts, and all copies of a string go, so there are no ties to break. Very long texts are read whole. An empty table gives an empty result;
    input columns stay inside ``row``, so their names cannot clash.
    """
    rows = apart(docs, text_col)
    rows = rows.withColumn("r", F.xxhash64("row", "text"))
    found = repeats(rows.select("r", "text"), length, batch_bytes).groupBy("r").agg(F.collect_list(F.struct("start", "stop")).alias("ranges")).withColumnRenamed("r", "q")
    joined = rows.join(found.hint("shuffle_merge"), F.col("r") == F.col("q"), "left").select("row", "text", "ranges")
    shape = joined.select("row", "text", *(F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans")), F.lit("").alias("kept_sha256")).schema
    return joined.mapInArrow(_keeper(keep_text), shape)


def op4_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op4_bwt_dedup": op4_bwt_dedup}
ORACLES: dict[str, str] = {}
