"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of all items is built on the driver from at most ``shard_words`` words and sent to the executors, so
what is broadcast has a fixed bound; a larger benchmark makes several automata, applied one after another
to the same rows. Training texts stream through it word by word: the state and matching length at a word give the longest
item substring that ends there. A word is hit where that length reaches a window (``window`` words, or a
whole shorter item).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkit
from tessera.llm.durable import apart, together

WINDOW = 13
SHARD_WORDS = 100_000
#: Words are runs of ASCII digits, letters and all bytes from 0x80, after A-Z are made lower case.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

SPANS = "array<struct<start:bigint,stop:bigint>>"


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends, hashes and the index of each text's first word."""
    starts, ends, first = textkit.runs(WORD[data], offsets)
    return starts, ends, textkit.Prefix(data, lower=True)(starts, ends), first


class Automaton:
    """Generalised suffix automaton over word hashes, with what its states need to report windows."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = [name for name, _ in items]
        self.shortest = min((min(len(words), window) for _, words in items), default=window)
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self._mark([words for _, words in items])
        self._sketch([words for _, words in items])

    def _copy(self, of: int, length: int) -> int:
        self.next.append(dict(self.next[of]))
        self.link.append(self.link[of])
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, word: int) -> int:
        """The state of (longest of ``state``) + word, cloned off its transition's target where that is longer."""
        to = self.next[state][word]
        if self.length[to] == self.length[state] + 1:
            return to
        clone = self._copy(to, self.length[state] + 1)
        self.link[to] = clone
        while state >= 0 and self.next[state].get(word) == to:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # another item has this prefix, or it is a substring
            return self._split(last, word)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word)
        return new

    def _mark(self, texts: list[list[int]]) -> None:
        """full: for states of window length or more, the items with the last ``window`` words; short: the short items that end here and are longer than what the suffix link stands for,
        one entry for each different sequence, and ``above`` leads to the next suffix that has any. All of it grows with the words of the items, however many are equal or hold each other."""
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        at: dict[int, set[int]] = {}
        self.short: dict[int, dict[int, list[int]]] = {}
        self.base = [0] * len(order)  # the ancestor whose class holds the suffix of ``window`` words
        for state in order[1:]:
            above = self.link[state]
            self.base[state] = self.base[above] if self.length[above] >= self.window else state if self.length[state] >= self.window else 0
        for item, words in enumerate(texts):
            state = 0
            for word in words:
                state = self.next[state][word]
                if self.length[state] >= self.window and self.base[state]:
                    at.setdefault(state, set()).add(item)
            if words and len(words) < self.window:
                self.short.setdefault(state, {}).setdefault(len(words), []).append(item)
        for state in reversed(order):  # items of longer strings also hold their suffixes
            above = self.link[state]
            if state in at and above > 0 and self.length[above] >= self.window:
                at.setdefault(above, set()).update(at[state])
        self.full = {state: frozenset(found) for state, found in at.items() if self.base[state] == state}
        self.above = [0] * len(order)
        for state in order[1:]:
            self.above[state] = self.link[state] if self.link[state] in self.short else self.above[self.link[state]]

    def _sketch(self, texts: list[list[int]]) -> None:
        """A bitmap of hashed word n-grams: text without a long enough stretch of them cannot hold a window."""
        self.gram = min(3, self.shortest)
        grams = []
        for words in texts:
            found, ok = textkit.windows(np.array(words, np.uint64), np.array([0, len(words)]), self.gram)
            grams.append(found[ok])
        grams = np.concatenate([*grams, np.zeros(0, np.uint64)])
        self.shift = np.uint64(64 - max(16, int(64 * len(grams) + 1).bit_length()))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[(grams >> self.shift).astype(np.int64)] = True

    def stretches(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word ranges, each inside one text, that may hold windows."""
        grams, ok = textkit.windows(hashes, first, self.gram)
        likely = ok & self.bits[(grams >> self.shift).astype(np.int64)]
        starts, ends, _ = textkit.runs(likely, first)
        long = ends - starts >= self.shortest - self.gram + 1
        return starts[long], ends[long] + self.gram - 1

    def run(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged hit ranges and items of one stretch."""
        nexts, link, length, window, full, short, base, above = self.next, self.link, self.length, self.window, self.full, self.short, self.base, self.above
        state = matched = 0
        hits: list[tuple[int, int]] = []
        items: set[int] = set()
        for i, word in enumerate(words):
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            to = nexts[state].get(word)
            if to is None:
                state = matched = 0
                continue
            state, matched = to, matched + 1
            widest = 0
            if matched >= window:
                widest = window
                items |= full[base[state]]
            at = state if state in short else above[state]
            while at:
                for n, equal in short[at].items():
                    if n <= matched:
                        widest = max(widest, n)
                        items.update(equal)
                at = above[at]
            if widest:
                start = i + 1 - widest
                while hits and hits[-1][1] >= start:
                    start = min(start, hits.pop()[0])
                hits.append((start, i + 1))
        return hits, items


def automata(benchmark: DataFrame, window: int, shard_words: int, id_col: str, text_col: str) -> Iterator[Automaton]:
    """Automata of at most about ``shard_words`` words; a longer item is cut with ``window - 1`` words of overlap."""
    items: list[tuple[str, list[int]]] = []
    held = 0
    for name, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).filter(F.col(id_col).isNotNull()).toLocalIterator():
        data, offsets = textkit.buffers(pa.array([text], pa.string()))
        words = word_hashes(data, offsets)[2].tolist()
        cuts = range(0, max(1, len(words) - window + 1), max(1, shard_words - window + 1))
        for part in [words[at : at + shard_words] for at in cuts] if len(words) > shard_words else [words]:
            if not part:
                continue
            if items and held + len(part) > shard_words:
                yield Automaton(items, window)
                items, held = [], 0
            items.append((name, part))
            held += len(part)
    yield Automaton(items, window)


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges as disjoint ranges in order."""
    if len(starts) < 2:
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return starts[new], reach[np.r_[new[1:] - 1, len(reach) - 1]]


def _scanner(sent, first_pass: bool):
    """For mapInArrow over (row, text[, n_words, hits, items])."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = sent.value
        for batch, data, offsets in textkit.pieces(batches):
            _, _, hashes, first = word_hashes(data, offsets)
            n = batch.num_rows
            hits: list[list[tuple[int, int]]] = [[] for _ in range(n)]
            items: list[set[str]] = [set() for _ in range(n)]
            if not first_pass:
                hits = [[(x["start"], x["stop"]) for x in row] for row in batch.column(3).to_pylist()]
                items = [set(row) for row in batch.column(4).to_pylist()]
            starts, ends = auto.stretches(hashes, first)
            for a, b, doc in zip(starts.tolist(), ends.tolist(), (np.searchsorted(first, starts, "right") - 1).tolist(), strict=True):
                found, names = auto.run(hashes[a:b].tolist())
                at = a - int(first[doc])
                hits[doc] += [(x + at, y + at) for x, y in found]
                items[doc] |= {auto.names[i] for i in names}
            merged = [_merge(*np.array(x, np.int64).reshape(-1, 2).T) if x else () for x in hits]
            spans = [[{"start": int(x), "stop": int(y)} for x, y in zip(*m, strict=True)] if m else [] for m in merged]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(first)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                ["row", "text", "n_words", "hits", "items"],
            )

    return scan


def scan(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, shard_words: int = SHARD_WORDS,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Rows (row, text, n_words, hits, items): the input row without its text as a struct, merged hit word ranges, ids of items with windows found.

    Null or empty texts have no words. Items without words or with a null id are left out; equal items are all reported. An empty
    benchmark hits nothing, an empty table gives an empty result. Input columns stay inside ``row``, so their
    names cannot clash. Several rows with one id are handled each on its own. Very long texts are streamed whole; no result depends on an order, so there are no ties.
    """
    spark = docs.sparkSession
    found = apart(docs, text_col)
    first = True
    for auto in automata(benchmark, window, shard_words, item_col, item_text_col):
        shape = found.select("row", "text", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(SPANS).alias("hits"), F.lit(None).cast("array<string>").alias("items")).schema
        found = found.mapInArrow(_scanner(spark.sparkContext.broadcast(auto), first), shape)
        first = False
    return found


def n_hit() -> Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])


def contaminated(coverage_inverse: int = 20) -> Column:
    """At least one hit word, and hit words are a twentieth of all or more."""
    return (n_hit() > 0) & (n_hit() * coverage_inverse >= F.col("n_words"))


def remove(docs: DataFrame, benchmark: DataFrame, *, longest: int | None = None, **options) -> DataFrame:
    """``docs`` without contaminated rows; with ``longest``, hit spans of that many words or more are also cut from the other texts.

    Null and empty texts are clean and stay; repeated rows stay or go alike; all columns stay as they are. An empty table gives an empty one.
    """
    found = scan(docs, benchmark, **options).filter(~contaminated())
    if longest is not None:
        kept = found.select("row", "text", F.filter("hits", lambda x: x["stop"] - x["start"] >= longest).alias("hits"))
        found = kept.mapInArrow(_cutter, found.select("row", "text").schema)
    return together(found, docs.columns, options.get("text_col", "text"))


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in textkit.pieces(batches):
        starts, ends, _, first = word_hashes(data, offsets)
        texts = batch.column(1).to_pylist()
        for i, spans in enumerate(batch.column(2).to_pylist()):
            if spans:
                raw, out, at = data[offsets[i] : offsets[i + 1]].tobytes(), [], 0
                for x in spans:
                    a, b = int(starts[first[i] + x["start"]] - offsets[i]), int(ends[first[i] + x["stop"] - 1] - offsets[i])
                    out.append(raw[at:a])
                    at = b
                texts[i] = b"".join([*out, raw[at:]]).decode()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "row.doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT item, w, least({WINDOW}, len(w)) AS k, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM win),
spots AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)),
hit AS (SELECT doc_id, spots.k, i, item FROM spots JOIN win ON spots.k = win.k AND spots.s = win.s),
n AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""

QUERIES = {"op6_decontam": op6_decontam}
ORACLES = {"op6_decontam": ORACLE}
