"""Language identification with bit-sliced Bloom filters of byte n-grams.

One table of masks holds the Bloom filters of all languages side by side: bit l of a slot belongs to language l's filter. The
conjunction of an n-gram's slots has the bits of all languages that contain it. For a text the bits are counted by language
over all its n-grams, the share that a filter of that fill returns by chance is taken off, and the largest corrected count decides.
The filters are fitted on a bounded sample of labelled rows (``sample_docs`` for each language); everything else covers whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkit
from tessera.llm.durable import apart

#: Bytes in an n-gram, hash functions, and documents for each language that the filters are fitted on.
GRAM, HASHES, SAMPLE_DOCS = 4, 2, 1500
#: Languages in one table of masks; more languages take several tables.
WIDTH = 8
UND = "und"

#: ASCII capitals to lower case; other ASCII bytes that are not letters to space.
FOLD = textkit.LOWER.copy()
FOLD[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32
_LETTER = regex.compile(r"\p{L}")
_STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def grams(data: np.ndarray, offsets: np.ndarray, size: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the folded texts, each with a space at either end, as numbers; and the text of each."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    padded = np.full(len(data) + 2 * n, 32, np.uint8)
    doc = np.repeat(np.arange(n), lengths)
    padded[np.arange(len(data)) + 2 * doc + 1] = FOLD[data]
    total = len(padded) - size + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    number = np.zeros(total, np.uint64)
    for j in range(size):
        number <<= np.uint64(8)
        number |= padded[j : j + total]
    owner = np.repeat(np.arange(n), lengths + 2)
    inside = owner[:total] == owner[size - 1 :]
    return number[inside], owner[:total][inside]


def slots(numbers: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(textkit.mixed(numbers * np.uint64(step)) >> np.uint64(64 - bits)).astype(np.int64) for step in _STEPS[:HASHES]]


class Filters:
    """Bit-sliced Bloom filters of up to WIDTH languages a table."""

    def __init__(self, languages: list[str], members: list[np.ndarray]):
        self.languages = languages
        self.bits = max(14, int(16 * max([len(m) for m in members], default=1)).bit_length())
        self.tables = []
        self.chance = np.zeros(len(languages))
        for base in range(0, len(languages), WIDTH):
            table = np.zeros(1 << self.bits, np.uint8)
            for i, own in enumerate(members[base : base + WIDTH]):
                for slot in slots(own, self.bits):
                    table[slot] |= np.uint8(1 << i)
                self.chance[base + i] = (np.count_nonzero(table & (1 << i)) / len(table)) ** HASHES
            self.tables.append(table)

    def counts(self, numbers: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of each text, and for each language how many of them it has, corrected for chance."""
        places = slots(numbers, self.bits)
        total = np.bincount(owner, minlength=n).astype(float)
        found = []
        for t, table in enumerate(self.tables):
            masks = table[places[0]]
            for place in places[1:]:
                masks &= table[place]
            by_mask = np.bincount(owner * 256 + masks, minlength=n * 256).reshape(n, 256)
            width = min(WIDTH, len(self.languages) - t * WIDTH)
            found.append(by_mask @ ((np.arange(256)[:, None] >> np.arange(width)) & 1))
        raw = np.concatenate(found, axis=1) if found else np.zeros((n, 0))
        return total, np.maximum((raw - total[:, None] * self.chance) / (1 - self.chance), 0)


def _gatherer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (lang, text): n-gram counts."""
    for batch, data, offsets in textkit.pieces(batches):
        langs = np.array(batch.column(0).to_pylist(), object)
        numbers, owner = grams(data, offsets)
        for lang in sorted(set(langs)):
            found, n = np.unique(numbers[langs[owner] == lang], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def fit(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters for the languages of ``docs``, from about ``sample_docs`` of each one's texts (drawn by a hash) and every n-gram they use twice or more.

    Rows without text or language teach nothing, an empty text has no n-grams, repeated rows are drawn alike and count each. Texts are read whole, however long. Languages with equally many texts
    are ranked by name. An empty table gives filters of no language. Other columns are not read.
    """
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return Filters([], [])
    rate = known.sparkSession.createDataFrame([(k, min(1.0, sample_docs / v)) for k, v in sizes.items()], "lang string, rate double")
    spot = F.pmod(F.xxhash64("text", F.length("text")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = known.join(F.broadcast(rate), "lang").filter(spot < F.col("rate")).select("lang", "text")
    found = drawn.mapInArrow(_gatherer, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter("n >= 2").toPandas()
    by_lang = {k: np.sort(v["gram"].to_numpy(np.int64)).astype(np.uint64) for k, v in found.groupby("lang")}
    languages = sorted(sizes, key=lambda k: (-sizes[k], k))  # ties go to the larger language
    return Filters(languages, [by_lang.get(k, np.zeros(0, np.uint64)) for k in languages])


def _teller(sent, keep_text: bool):
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: Filters = sent.value
        names = np.array([*filters.languages, UND], object)
        for batch, data, offsets in textkit.pieces(batches):
            n = batch.num_rows
            lower = np.r_[0, np.cumsum((FOLD[data] != 32) & (data < 128))]
            lettered = lower[offsets[1:]] > lower[offsets[:-1]]
            for i in np.flatnonzero(~lettered & (np.diff(offsets) > 0)):
                lettered[i] = bool(_LETTER.search(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
            best, sure, cover = np.full(n, len(filters.languages)), np.zeros(n), np.zeros(n)
            if filters.languages:
                total, found = filters.counts(*grams(data, offsets), n)
                best = np.where(lettered, found.argmax(axis=1), best)
                top = found.max(axis=1)
                others = np.sort(found, axis=1)[:, -2] if len(filters.languages) > 1 else np.zeros(n)
                sure = np.where(lettered, np.where(top > 0, top / np.maximum(top + others, 1e-9), 1 / len(filters.languages)), 0.0)
                cover = np.where(lettered, np.minimum(top / np.maximum(total, 1), 1.0), 0.0)
            out = {"row": batch.column(0), "lang_pred": pa.array(names[best].tolist(), pa.string()), "score": pa.array(sure.clip(0, 1)), "coverage": pa.array(cover)}
            yield pa.RecordBatch.from_pydict(out | ({"text": batch.column(1)} if keep_text else {}))

    return tell


def identify(docs: DataFrame, filters: Filters, *, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Rows (row, lang_pred, score, coverage[, text]) for every row of ``docs``: the input row without its text as a struct, the language, and two figures from 0 to 1.

    ``score`` is the best language's count over its own and the runner-up's; ``coverage`` is the share of the text's n-grams that
    the best language has. Equal counts go to the language with more texts in the fit. Very long texts are read whole; repeated rows get equal results; input columns stay inside ``row``, so their names
    cannot clash; an empty table gives an empty result. Null texts, texts without a letter, and all texts if no language was learned, are ``und`` with score 0.
    """
    rows = apart(docs, text_col)
    shape = rows.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("coverage"), *(["text"] if keep_text else [])).schema
    return rows.mapInArrow(_teller(docs.sparkSession.sparkContext.broadcast(filters), keep_text), shape)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 on division by 4; a null id is held out too, so it teaches nothing."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    filters = fit(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text"), filters).select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score", "coverage")


QUERIES = {"op3_langid": op3_langid}
ORACLES: dict[str, str] = {}
