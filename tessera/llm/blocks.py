"""Groups of rows that are worked on pair by pair, whatever their size.

Rows arrive sorted by group. A group of up to ``limit`` (rows, or whatever ``weigh`` measures) is worked on in the task that reads it. A larger
one is cut into blocks of that size, which are handed on; a second step deals out every pair of its blocks to tasks of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.durable import drop, settle


def _stream(work: Callable, limit: int, weigh: Callable, names: list[str], kinds: list[pa.DataType]):
    """For mapInArrow over (key, *payload) sorted by key: pairs (a, b), and rows of groups that are too large with their block's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[int, int]] = []
        large: list[tuple] = []

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            if len(pairs) + len(large) > least:
                n, m = len(pairs), len(large)
                columns = [pa.array([x[i] for x in pairs] + [None] * m, pa.int64()) for i in (0, 1)]
                columns += [pa.array([None] * n + [x[i] for x in large], t) for i, t in enumerate([*kinds, pa.int64()])]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", *names, "block"])
                pairs.clear()
                large.clear()

        key, rows, weight, block = None, [], 0, 0

        def close() -> None:
            nonlocal rows, weight, block
            if block:
                large.extend((key, *r, block) for r in rows)
            elif len(rows) > 1:
                pairs.extend(work(rows, None))
            rows, weight = [], 0

        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    close()
                    key, block = k, 0
                elif weight >= limit:
                    block = max(block, 1)
                    close()
                    block += 1
                    yield from flush(1000)
                rows.append(row)
                weight += weigh(row)
            yield from flush(10_000)
        close()
        yield from flush(0)

    return run


def _pair(work: Callable, names: list[str]):
    """For applyInArrow over two blocks of one group (or one with itself)."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(n).to_pylist() for n in names), strict=True))
        sides = table.column("block").to_pylist()
        found = list(work([list(r) for r in rows], sides))
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return run


def within_groups(rows: DataFrame, work: Callable, *, limit: int, order: str, weigh: Callable = lambda row: 1) -> DataFrame:
    """Distinct pairs (a, b) that ``work(payload rows, sides)`` finds within the groups of ``rows`` (key, *payload).

    ``sides`` is None for a whole group; for two blocks it has the block of each row, and pairs within one of two blocks may be left to the task that has this block alone.
    """
    names = rows.columns
    kinds = [pa.binary() if t == "binary" else pa.string() if t == "string" else pa.int64() for _, t in rows.dtypes]
    fields = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    found = rows.repartition(names[0]).sortWithinPartitions(names[0], order).mapInArrow(_stream(work, limit, weigh, names, kinds), f"a long, b long, {fields}, block long")
    found = settle(found, "pairs")
    pairs = found.filter("a IS NOT NULL").select("a", "b")
    large = found.filter("block IS NOT NULL")
    if large.head(1):
        last = large.groupBy(names[0]).agg(F.max("block").alias("_last"))
        dealt = large.join(last, names[0]).withColumn("_other", F.explode(F.sequence(F.lit(1), F.col("_last"))))
        low, high = F.least("block", "_other").alias("_low"), F.greatest("block", "_other").alias("_high")
        dealt = dealt.select(*names, "block", low, high)
        pairs = pairs.union(dealt.groupBy(names[0], "_low", "_high").applyInArrow(_pair(work, names[1:]), "a long, b long"))
    whole = settle(pairs.distinct(), "linked-pairs")
    drop(found)
    return whole
