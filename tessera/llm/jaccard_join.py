"""N-gram Jaccard join with R-trees over count vectors.

A text's shingles are hashed into groups; the group counts are a point. Two sets share at most the sum over groups of the smaller
count, so a box with upper corner h holds no partner of a point q if the sum of min(q, h) is below what the
threshold asks for. Copies of one set are one class. To use more than one machine, classes are dealt into buckets:
sets over the threshold share one of their first shingles in a common order (rare hash cells first, from a count of all shingles), so
every linked pair meets in some bucket. Each bucket's R-tree gives a spanning forest of the pairs that the bound lets through; the trees of that
forest over all buckets are closed groups that no link leaves. Their texts are then fetched once, and an R-tree in each group finds
the pairs to verify on the full sets, passing over boxes that are linked to the point already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkit
from tessera.llm.blocks import within_groups
from tessera.llm.durable import drop, settle
from tessera.llm.graph import components

WIDTH, PERCENT = 4, 85
CELL_BITS = 15
LEAF = 64
#: Rows of a bucket, and bytes of text of a group, that one task takes at once.
BUCKET_ROWS, GROUP_BYTES = 30_000, 6 << 20
FULL = 255


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The set of each text: hashes of its windows of ``width`` words; of all its words if it has fewer."""
    starts, ends, first = textkit.runs(~textkit.SPACE[data], offsets)
    hashes = textkit.Prefix(data, lower=True)(starts, ends)
    grams, ok = textkit.windows(hashes, first, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(grams[a:b][ok[a:b]])
        elif b > a:
            yield textkit.windows(hashes[a:b], np.array([0, b - a]), b - a)[0][:1]
        else:
            yield np.zeros(0, np.uint64)


def n_groups(n: int, percent: int = PERCENT) -> int:
    """Groups for a set of n shingles: a power of two, enough for the bound to tell unrelated sets from partners.

    Partners' counts differ by at most 2 n (100 - p) / (100 + p) in sum; those of unrelated sets by about 1.13 sqrt(n g) for g groups, with a deviation of 0.85 sqrt(n). Four to
    five deviations apart, sets that merely share a shingle do not grow together into one closed group.
    """
    root = 2 * (100 - percent) / (100 + percent) / 1.13 * n**0.5 + 4
    return 1 << max(5, int(root * root - 1).bit_length())


def fine_groups(n: int) -> int:
    """Groups for a set inside a closed group, where points do not travel: so many that the bound is close to the true overlap."""
    return min(8192, max(64, 1 << (2 * n).bit_length()))


def point(members: np.ndarray, g: int | None = None) -> np.ndarray:
    """Group counts as bytes; a full byte stands for that many or more."""
    g = g or n_groups(len(members))
    return np.minimum(np.bincount((textkit.mixed(members) & np.uint64(g - 1)).astype(np.int64), minlength=g), FULL).astype(np.uint8)


def signature(members: np.ndarray) -> tuple[int, int]:
    a, b = textkit.mixed(members + np.uint64(1)), textkit.mixed(members ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return int(np.bitwise_xor.reduce(a).astype(np.int64)) if len(a) else 0, int(b.sum(dtype=np.uint64).astype(np.int64))


class CountTree:
    """R-tree over count points of g groups with their set sizes; points of twice as many groups are folded.

    ``members`` are the points' numbers outside. Two folded points are no pair here: they meet in a tree of their own.
    """

    def __init__(self, points: list[np.ndarray], sizes: list[int], percent: int, members: np.ndarray | None = None):
        g = min(map(len, points))
        self.points = np.array([fold(p, g) for p in points], np.uint8)
        self.own = np.array([len(p) == g for p in points])
        self.sizes = np.array(sizes, np.int64)
        self.percent = percent
        self.members = np.arange(len(points)) if members is None else members
        self.order = np.arange(len(points))
        #: (from, to, upper corner, smallest and largest size, left child, right child)
        self.nodes: list[tuple] = []
        self._build(0, len(points))

    def _build(self, a: int, b: int) -> int:
        own = self.order[a:b]
        if b - a > LEAF:  # cut at the median of the widest coordinate, or of the sizes where those differ more
            spread = (self.points[own].max(axis=0) - self.points[own].min(axis=0)).astype(np.int64)
            by = self.sizes if np.ptp(self.sizes[own]) > 2 * spread.max() else self.points[:, spread.argmax()]
            own = self.order[a:b] = own[np.argsort(by[own], kind="stable")]
        at = len(self.nodes)
        self.nodes.append(())
        left = right = -1
        if b - a > LEAF:
            left, right = self._build(a, (a + b) // 2), self._build((a + b) // 2, b)
            own = self.order[a:b]
        self.nodes[at] = (a, b, self.points[own].max(axis=0), int(self.sizes[own].min()), int(self.sizes[own].max()), left, right)
        return at

    def shared(self, q: np.ndarray, corner: np.ndarray) -> np.ndarray:
        """Most shingles that a set at q can share with one below the corner (or each of several corners)."""
        least = np.minimum(q, corner)
        return np.where(((q == FULL) & (corner == FULL)).any(axis=-1), 1 << 40, least.sum(axis=-1, dtype=np.int64))

    def search(self, i: int, label: np.ndarray) -> Iterator[int]:
        """Members the bound allows as partners of the tree's point i, with labels other than its own as they are then."""
        q, n, p, me = self.points[i], int(self.sizes[i]), self.percent, self.members[i]
        stack = [0]
        while stack:
            a, b, corner, least, most, left, right = self.nodes[stack.pop()]
            if 100 * most < p * n or 100 * n < p * least:
                continue
            if (100 + p) * min(int(self.shared(q, corner)), n, most) < p * (n + least):
                continue
            own = self.order[a:b]
            if (label[self.members[own]] == label[me]).all():
                continue
            if left >= 0:
                stack += (right, left)
                continue
            sizes = self.sizes[own]
            fits = (100 + p) * np.minimum(self.shared(q, self.points[own]), np.minimum(n, sizes)) >= p * (n + sizes)
            if not self.own[i]:
                fits &= self.own[own]
            for j in self.members[own[fits]].tolist():
                if label[j] != label[me]:
                    yield j


def fold(p: np.ndarray, g: int) -> np.ndarray:
    """A point with the counts of g groups."""
    return p if len(p) == g else np.minimum(p.reshape(-1, g).sum(axis=0, dtype=np.int64), FULL)


def forest(points: list[np.ndarray], sizes: list[int], percent: int, test=None) -> Iterator[tuple[int, int]]:
    """Pairs that span the groups of points linked by the bound and, if given, by ``test(i, j)``.

    Partners' sizes are close, so they have equally many groups, or one twice as many: a tree for each number of groups holds both.
    """
    label = np.arange(len(points))
    held = {i: [i] for i in range(len(points))}
    groups = np.array([len(p) for p in points])
    for g in np.unique(groups):
        members = np.flatnonzero((groups == g) | (groups == 2 * g))
        if len(members) < 2:
            continue
        tree = CountTree([points[i] for i in members], [sizes[i] for i in members], percent, members)
        for at, i in enumerate(members.tolist()):
            for j in tree.search(at, label):
                if label[j] == label[i] or (test is not None and not test(i, j)):
                    continue
                big, low = label[i], label[j]
                if len(held[big]) < len(held[low]):
                    big, low = low, big
                moved = held.pop(low)
                label[moved] = big
                held[big] += moved
                yield i, j


def _set_maker(width: int, percent: int, sent):
    """For mapInArrow over (name, text): size, signature, first shingles in the common order, point."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value
        shift, low = np.uint64(64 - CELL_BITS), np.uint64((1 << (64 - CELL_BITS)) - 1)
        for batch, data, offsets in textkit.pieces(batches):
            out = []
            for members in shingles(data, offsets, width):
                n = len(members)
                ordered = np.sort((place[(members >> shift).astype(np.int64)] << shift) | (members & low))
                keys = ordered[: n - -(-percent * n // 100) + 1] if n else ordered
                out.append((n, *signature(members), keys.view(np.int64), point(members, n_groups(n, percent)).tobytes() if n else b""))
            n, one, two, keys, points = zip(*out, strict=True)
            bounds = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(keys))), pa.array(points, pa.binary())],
                ["name", "n", "one", "two", "keys", "point"],
            )

    return make


def _cell_counter(width: int):
    """For mapInArrow over (id, text): shingles in each cell of the hash range."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for _, data, offsets in textkit.pieces(batches):
            starts, ends, first = textkit.runs(~textkit.SPACE[data], offsets)
            grams, ok = textkit.windows(textkit.Prefix(data, lower=True)(starts, ends), first, width)
            cells += np.bincount((grams[ok] >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells))
        full = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(cells[full])], ["cell", "n"])

    return count


def _bucket_worker(percent: int):
    """Work on (cid, n, point) rows of a bucket."""
    cache: dict[int, np.ndarray] = {}

    def work(rows: list[list], sides: list[int] | None) -> Iterator[tuple[int, int]]:
        if len(cache) > 100_000:
            cache.clear()
        points = [cache.setdefault(r[0], np.frombuffer(r[2], np.uint8)) for r in rows]
        sizes = [r[1] for r in rows]
        if len(rows) == 2:  # a tree of one leaf
            (a, b), (x, y) = points, sizes
            if 100 * min(x, y) < percent * max(x, y):
                return
            g = min(len(a), len(b))
            least = np.minimum(fold(a, g), fold(b, g))
            if least.max() < FULL and (100 + percent) * min(int(least.sum(dtype=np.int64)), x, y) < percent * (x + y):
                return
            yield rows[0][0], rows[1][0]
            return
        for i, j in forest(points, sizes, percent):
            yield rows[i][0], rows[j][0]

    return work


def _group_worker(width: int, percent: int):
    """Work on (cid, text) rows of a closed group: links verified on the full sets."""

    def work(rows: list[list], sides: list[int] | None) -> Iterator[tuple[int, int]]:
        sets: dict[int, np.ndarray] = {}
        for cid, text in rows:
            if cid not in sets:
                data, offsets = textkit.buffers(pa.array([text], pa.string()))
                members = next(shingles(data, offsets, width))
                if signature(members)[1] == cid:  # else another row with the same id
                    sets[cid] = members
        ids, members = list(sets), list(sets.values())
        if len(ids) < 2:
            return

        def linked(i: int, j: int) -> bool:
            both = len(np.intersect1d(members[i], members[j], assume_unique=True))
            return 100 * both >= percent * (len(members[i]) + len(members[j]) - both)

        for i, j in forest([point(m, fine_groups(len(m))) for m in members], [len(m) for m in members], percent, linked):
            yield ids[i], ids[j]

    return work


def jaccard_join(
    docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
    bucket_rows: int = BUCKET_ROWS, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of ``docs``.

    Two documents link when 100 * shared shingles >= percent * all shingles of both; a component is what links reach. Null and empty texts, and texts of white
    space, have no shingles and link with nothing. Rows with equal texts link whatever their ids, repeated ids
    included; a row with a null id takes part as any other and gets the component of its set, or null where no row reached by links has an id. Very long texts are read whole, in pieces of a few MB at once between texts.
    Ties of sizes and shingles change nothing in the result. An empty table gives an empty result. Other columns are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    # a row is named by its id and its text's hash, so that rows without an id take part, too
    texts = docs.select(F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("r")).alias("name"), F.col(text_col).alias("text"))
    counted = texts.mapInArrow(_cell_counter(width), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    load = np.zeros(1 << CELL_BITS, np.int64)
    load[counted["cell"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    place = np.empty(1 << CELL_BITS, np.uint64)
    place[np.argsort(load, kind="stable")] = np.arange(1 << CELL_BITS, dtype=np.uint64)
    maker = _set_maker(width, percent, spark.sparkContext.broadcast(place))
    sets = settle(texts.mapInArrow(maker, "name struct<id:long,r:long>, n long, one long, two long, keys array<long>, point binary"), "jaccard-sets")

    least_name = F.min(F.struct(F.col("name.id").isNull().alias("none"), F.col("name.id").alias("id"), F.col("name.r").alias("r"))).alias("least")
    classes = sets.filter("n > 0").groupBy("one", "two", "n").agg(least_name, F.first("keys").alias("keys"), F.first("point").alias("point"))
    classes = settle(classes.select("one", F.col("two").alias("cid"), "n", F.col("least.id").alias("rep"), F.col("least.r").alias("rep_r"), "keys", "point"), "jaccard-classes")
    # shingles that one class alone has are counted out by partial sums, and the others joined back, which splits a common one
    spots = classes.select(F.explode("keys").alias("key"), "cid")
    shared = spots.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("key").alias("s"))
    shared = settle(spots.join(shared.hint("shuffle_merge"), F.col("key") == F.col("s")).select("key", "cid"), "jaccard-keys")
    points = classes.select(F.col("cid").alias("c"), "n", "point")
    rows = shared.join(points.hint("shuffle_merge"), F.col("cid") == F.col("c")).select("key", "cid", "n", "point")
    near = within_groups(rows, _bucket_worker(percent), limit=bucket_rows, order="n")
    drop(shared)

    closed = components(near)
    asked = classes.select("cid", "rep", "rep_r").join(closed, F.col("cid") == F.col("node")).select("root", "cid", "rep", "rep_r")
    fetched = texts.join(asked.hint("shuffle_merge"), (F.col("name.r") == F.col("rep_r")) & F.col("name.id").eqNullSafe(F.col("rep"))).select("root", "cid", "text")
    links = within_groups(fetched, _group_worker(width, percent), limit=group_bytes, order="cid", weigh=lambda row: len(row[1]))
    found = components(links).select("node", F.col("root").alias("group"))

    named = classes.select("one", "cid", "n", "rep").join(found, F.col("cid") == F.col("node"), "left")
    least = named.filter("group IS NOT NULL").groupBy("group").agg(F.min("rep").alias("least")).withColumnRenamed("group", "g")
    named = named.join(least, F.col("group") == F.col("g"), "left").select(F.col("one").alias("o"), F.col("cid").alias("c"), F.col("n").alias("m"), F.coalesce("least", "rep").alias("component"))
    full = sets.filter("n > 0").select("name.id", "n", "one", "two")
    full = full.join(named.hint("shuffle_merge"), (F.col("one") == F.col("o")) & (F.col("two") == F.col("c")) & (F.col("n") == F.col("m")))
    empty = sets.filter("n = 0").select("name.id", "n").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    result = settle(full.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).union(empty), "jaccard-result")
    drop(sets, classes, near, links)
    return result


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id. Rows with null ids stay unless their set has a row with an id; of rows equal in id and text one stays."""
    found = jaccard_join(docs, id_col=id_col, text_col=text_col, **options)
    name = next(c for c in (f"keep{i}" for i in range(len(docs.columns) + 1)) if c not in docs.columns)
    keep = found.filter("component_id IS NULL OR doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    rows = docs.join(keep.hint("shuffle_merge"), F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(name))).drop(name)
    return rows.dropDuplicates([id_col, text_col])


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_jaccard_join": op1_jaccard_join}
ORACLES: dict[str, str] = {}
