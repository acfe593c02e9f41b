"""Lists, sets, hashes, sorted sets and streams as child tables, and SORT over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# --- sorted sets (key, member, score): ordered by score, then by the member's bytes ---


def _ranked():
    return W.partitionBy("key").orderBy("score", "member")


def zset_rank(z: DataFrame) -> DataFrame:
    """(key, member, score, rank, rev_rank), ranks from 0."""
    return z.withColumn("rank", (F.row_number().over(_ranked()) - 1).cast("long")).withColumn("rev_rank", (F.count("*").over(W.partitionBy("key")) - 1 - F.col("rank")).cast("long"))


def zset_by_rank(z: DataFrame, start: int, stop: int) -> DataFrame:
    """Members of ranks start to stop, both included; negative ranks count from the end."""
    rows = zset_rank(z)
    edge = lambda i: F.lit(i) if i >= 0 else F.col("rank") + F.col("rev_rank") + 1 + i
    return rows.filter(F.col("rank").between(edge(start), edge(stop)))


def _inside(column: Column, low, high, low_open: bool, high_open: bool) -> Column:
    test = F.lit(True)
    if low is not None:
        test &= column > low if low_open else column >= low
    if high is not None:
        test &= column < high if high_open else column <= high
    return test


def zset_range_score(z: DataFrame, low: float | None, high: float | None, low_open: bool = False, high_open: bool = False) -> DataFrame:
    """Members with scores in a range; None is unbounded. A range that is empty by its bounds gives nothing."""
    return z.filter(_inside(F.col("score"), low, high, low_open, high_open))


def zset_range_lex(z: DataFrame, low: str | None, high: str | None, low_open: bool = False, high_open: bool = False) -> DataFrame:
    """Members between two byte strings, for sets whose scores are equal."""
    return z.filter(_inside(F.col("member"), low, high, low_open, high_open))


def zset_count(z: DataFrame, low: float | None, high: float | None) -> DataFrame:
    return zset_range_score(z, low, high).groupBy("key").agg(F.count("*").alias("n"))


def zset_delete_by_rank(z: DataFrame, start: int, stop: int) -> DataFrame:
    """What is left once ranks start to stop are gone."""
    gone = zset_by_rank(z, start, stop).select("key", "member")
    return z.join(gone, ["key", "member"], "left_anti")


def zset_delete_by_score(z: DataFrame, low: float | None, high: float | None, low_open: bool = False, high_open: bool = False) -> tuple[DataFrame, DataFrame]:
    """What is left once the scores in a range are gone, and what went."""
    test = _inside(F.col("score"), low, high, low_open, high_open)
    return z.filter(~test), z.filter(test)


def zset_delete_by_lex(z: DataFrame, low: str | None, high: str | None, low_open: bool = False, high_open: bool = False) -> tuple[DataFrame, DataFrame]:
    test = _inside(F.col("member"), low, high, low_open, high_open)
    return z.filter(~test), z.filter(test)


def zset_ends(z: DataFrame) -> DataFrame:
    """(key, first, first_score, last, last_score)."""
    at = F.struct("score", "member")
    rows = z.groupBy("key").agg(F.min(at).alias("a"), F.max(at).alias("b"))
    return rows.select("key", F.col("a.member").alias("first"), F.col("a.score").alias("first_score"), F.col("b.member").alias("last"), F.col("b.score").alias("last_score"))


def zset_ends_in_range(z: DataFrame, low: float | None, high: float | None, low_open: bool = False, high_open: bool = False) -> DataFrame:
    """(key, first_rank, last_rank) of the members with scores in a range; sets without any are left out.

    Ranks follow from counts: what lies before the range, and what lies in it.
    """
    inside = _inside(F.col("score"), low, high, low_open, high_open)
    below = F.lit(False) if low is None else F.col("score") <= low if low_open else F.col("score") < low
    rows = z.groupBy("key").agg(F.count_if(below).alias("before"), F.count_if(inside).alias("n")).filter("n > 0")
    return rows.select("key", F.col("before").alias("first_rank"), (F.col("before") + F.col("n") - 1).alias("last_rank"))


def zset_pop(z: DataFrame, count: int, highest: bool = False) -> tuple[DataFrame, DataFrame]:
    """The sets without their ``count`` lowest or highest members, and those."""
    gone = zset_by_rank(z, -count, -1) if highest else zset_by_rank(z, 0, count - 1)
    gone = gone.select("key", "member", "score")
    return z.join(gone.select("key", "member"), ["key", "member"], "left_anti"), gone


def zset_upsert(z: DataFrame, batch: DataFrame) -> DataFrame:
    """Scores of ``batch`` (key, member, score) replace or add; zero has one sign."""
    new = batch.withColumn("score", F.col("score") + 0.0)
    return z.join(new.select("key", "member"), ["key", "member"], "left_anti").unionByName(new)


def zset_combine(z: DataFrame, keys: list[str], how: str = "union", weight: dict[str, float] | None = None, aggregate: str = "sum") -> DataFrame:
    """(member, score) of the union, intersection or (first less others) difference of sorted sets, weighted and summed, or least, or greatest."""
    rows = z.filter(F.col("key").isin(keys))
    scale = F.coalesce(*[F.when(F.col("key") == k, F.lit(float(w))) for k, w in (weight or {}).items()], F.lit(1.0))
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[aggregate]
    got = rows.withColumn("score", F.col("score") * scale).groupBy("member").agg(fold("score").alias("score"), F.count("*").alias("n"), F.min(F.col("key") == keys[0]).alias("only_first"))
    got = {"union": got, "inter": got.filter(F.col("n") == len(set(keys))), "diff": got.filter(F.col("only_first"))}[how]
    return got.select("member", "score")


# --- lists (key, pos, elem) ---


def _at():
    return W.partitionBy("key").orderBy("pos")


def list_renumber(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pos", (F.row_number().over(_at()) - 1).cast("long"))


def _sized(rows: DataFrame) -> DataFrame:
    return list_renumber(rows).withColumn("n", F.count("*").over(W.partitionBy("key")))


def list_index(rows: DataFrame, index: int) -> DataFrame:
    """(key, elem) at an index; negative ones count from the end."""
    return _sized(rows).filter(F.col("pos") == (F.lit(index) if index >= 0 else F.col("n") + index)).select("key", "elem")


def list_range(rows: DataFrame, start: int, stop: int) -> DataFrame:
    edge = lambda i: F.lit(i) if i >= 0 else F.col("n") + i
    return _sized(rows).filter(F.col("pos").between(edge(start), edge(stop))).drop("n")


def list_remove_value(rows: DataFrame, value: str, count: int) -> DataFrame:
    """Without the first ``count`` equal elements of each list; from the end if negative, all if 0."""
    hit = F.col("elem") == value
    order = F.col("pos").desc() if count < 0 else F.col("pos").asc()
    nth = F.row_number().over(W.partitionBy("key", "elem").orderBy(order))
    kept = rows.withColumn("_nth", nth).filter(~hit | (F.col("_nth") > abs(count))) if count else rows.filter(~hit)
    return list_renumber(kept.drop("_nth"))


def list_push(rows: DataFrame, items: DataFrame, front: bool = False) -> DataFrame:
    """With ``items`` (key, ordinal, elem) at an end of their lists; each goes outside the one before it."""
    edges = rows.groupBy("key").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    n = F.row_number().over(W.partitionBy("key").orderBy("ordinal"))
    spot = F.coalesce("lo", F.lit(0)) - n if front else F.coalesce("hi", F.lit(-1)) + n
    added = items.join(edges, "key", "left").select("key", spot.cast("long").alias("pos"), "elem")
    return list_renumber(rows.select("key", "pos", "elem").union(added))


def list_pop(rows: DataFrame, count: int = 1, front: bool = True) -> tuple[DataFrame, DataFrame]:
    """The lists without ``count`` elements of an end, and those (key, place, elem) in the order they come off."""
    sized = _sized(rows)
    place = F.col("pos") if front else F.col("n") - 1 - F.col("pos")
    taken = sized.withColumn("place", place.cast("long"))
    return list_renumber(taken.filter(F.col("place") >= count).select("key", "pos", "elem")), taken.filter(F.col("place") < count).select("key", "place", "elem")


def list_ends(rows: DataFrame) -> DataFrame:
    """(key, head, tail)."""
    return rows.groupBy("key").agg(F.min_by("elem", "pos").alias("head"), F.max_by("elem", "pos").alias("tail"))


def list_nodes(rows: DataFrame, fill: int) -> DataFrame:
    """(key, nodes) of lists filled from one end, for a positive fill: elements a node."""
    if fill < 1:
        raise ValueError("a fill by size depends on the order of edits")
    return rows.groupBy("key").agg(F.ceil(F.count("*") / F.lit(fill)).alias("nodes"))


def list_find(rows: DataFrame, value: str, start: int = 0, skip: int = 0) -> DataFrame:
    """(key, pos) of the first equal element from ``start`` on, looking at one in every ``skip + 1``: fields of pairs, with a skip of 1."""
    seen = rows.filter((F.col("pos") >= start) & ((F.col("pos") - start) % (skip + 1) == 0) & (F.col("elem") == value))
    return seen.groupBy("key").agg(F.min("pos").alias("pos"))


#: Bytes before and after the elements, and the ranges that each way of packing an integer holds (bits, bytes).
PACK_FRAME, PACK_INTEGERS = 7, ((12, 2), (15, 3), (23, 4), (31, 5))


def packed_size(elem: Column) -> Column:
    """Bytes of an element in a packed list: its encoding, and that one's length written backwards."""
    from tessera.functions.scalars import strict_long

    value, n = strict_long(elem), F.octet_length(elem).cast("long")
    ladder = F.when(value.between(0, 127), 1)
    for bits, size in PACK_INTEGERS:
        ladder = ladder.when(value.between(-(1 << bits), (1 << bits) - 1), size)
    size = F.when(value.isNotNull(), ladder.otherwise(9)).when(n < 64, n + 1).when(n < 4096, n + 2).otherwise(n + 5)
    return (size + F.when(size <= 127, 1).when(size < 16383, 2).when(size < 2097151, 3).when(size < 268435455, 4).otherwise(5)).cast("long")


def list_packed(rows: DataFrame) -> DataFrame:
    """(key, n, bytes) of each list as one packed list."""
    return rows.groupBy("key").agg(F.count("*").alias("n"), (F.sum(packed_size(F.col("elem"))) + PACK_FRAME).alias("bytes"))


def list_set(rows: DataFrame, index: int, value: str) -> DataFrame:
    at = F.lit(index) if index >= 0 else F.col("n") + index
    return _sized(rows).withColumn("elem", F.when(F.col("pos") == at, value).otherwise(F.col("elem"))).drop("n")


def list_insert(rows: DataFrame, pivot: str, value: str, after: bool = False) -> DataFrame:
    """With a value next to the first element equal to ``pivot`` in each list that has one."""
    spot = rows.filter(F.col("elem") == pivot).groupBy("key").agg(F.min("pos").alias("p"))
    added = spot.select("key", (F.col("p") + (0.5 if after else -0.5)).alias("pos"), F.lit(value).alias("elem"))
    both = rows.select("key", F.col("pos").cast("double").alias("pos"), "elem").union(added)
    return list_renumber(both)


def list_delete_range(rows: DataFrame, start: int, count: int) -> DataFrame:
    at = F.lit(start) if start >= 0 else F.greatest(F.col("n") + start, F.lit(0))
    return list_renumber(_sized(rows).filter(~((F.col("pos") >= at) & (F.col("pos") < at + count))).drop("n"))


def list_position(rows: DataFrame, value: str, last: bool = False) -> DataFrame:
    return rows.filter(F.col("elem") == value).groupBy("key").agg((F.max("pos") if last else F.min("pos")).alias("pos"))


# --- sets (key, member) ---


def set_algebra(s: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Members in any, all, or the first but none of the others of the sets named."""
    got = s.filter(F.col("key").isin(keys)).groupBy("member").agg(F.count_distinct("key").alias("n"), F.min(F.col("key") == keys[0]).alias("only_first"))
    return {"union": got, "inter": got.filter(F.col("n") == len(set(keys))), "diff": got.filter("only_first")}[how].select("member")


def set_contains(s: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.join(s.select("key", "member", F.lit(1).alias("hit")).distinct(), ["key", "member"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def intset_width(ever: DataFrame) -> DataFrame:
    """(key, n, least, most, width): bytes for a member, by the widest that was ever added."""
    fits = lambda bits: (F.col("least") >= -(1 << bits)) & (F.col("most") < (1 << bits))
    got = ever.groupBy("key").agg(F.count_distinct("member").alias("n"), F.min("member").alias("least"), F.max("member").alias("most"))
    return got.withColumn("width", F.when(fits(15), 2).when(fits(31), 4).otherwise(8))


def intset_edit(s: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """(key, member) once members are added and then others removed."""
    return s.select("key", "member").union(add.select("key", "member")).distinct().join(remove.select("key", "member"), ["key", "member"], "left_anti")


def intset_walk(s: DataFrame, backward: bool = False) -> DataFrame:
    """(key, place, member) in ascending or descending order."""
    order = F.col("member").desc() if backward else F.col("member").asc()
    return s.select("key", "member").distinct().withColumn("place", (F.row_number().over(W.partitionBy("key").orderBy(order)) - 1).cast("long"))


def set_random(s: DataFrame, seed: str) -> DataFrame:
    """(key, member): one of each set, drawn by a seeded hash."""
    return s.groupBy("key").agg(F.min_by("member", F.md5(F.concat_ws(":", F.lit(seed), "key", F.col("member").cast("string")))).alias("member"))


def intset_at(s: DataFrame, index: int) -> DataFrame:
    return s.distinct().withColumn("i", F.row_number().over(W.partitionBy("key").orderBy("member")) - 1).filter(F.col("i") == index).select("key", "member")


# --- hashes (key, field, value) ---


def hash_get(h: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.join(h, ["key", "field"], "left")


def hash_increment(h: DataFrame, field: str, by: int) -> DataFrame:
    """(key, value) of an integer field after adding; null where that leaves 64 bits or is no integer."""
    from tessera.functions.scalars import strict_long

    return h.filter(F.col("field") == field).select("key", F.try_add(strict_long(F.col("value")), F.lit(by).cast("long")).alias("value"))


def hash_summary(h: DataFrame) -> DataFrame:
    return h.groupBy("key").agg(F.count("*").alias("fields"), F.sum(F.octet_length("value")).alias("value_bytes"))


# --- streams and other ordered maps (key, ms, seq, ...) ---


def seek(rows: DataFrame, how: str, ms: int, seq: int = 0) -> DataFrame:
    """Entries in ascending order from the first one at or after (``ge``), after (``gt``), or from the last at or before (``le``), before (``lt``) an id; none if there is no such entry."""
    at = F.struct("ms", "seq")
    mark = F.struct(F.lit(ms).cast("long").alias("ms"), F.lit(seq).cast("long").alias("seq"))
    if how in ("ge", "gt"):
        return rows.filter(at >= mark if how == "ge" else at > mark)
    start = rows.filter(at <= mark if how == "le" else at < mark).groupBy("key").agg(F.max(at).alias("from"))
    return rows.join(start, "key").filter(at >= F.col("from")).drop("from")


def seek_back(rows: DataFrame, how: str, ms: int, seq: int = 0) -> DataFrame:
    """The same four starts, for walking in descending order."""
    at = F.struct("ms", "seq")
    mark = F.struct(F.lit(ms).cast("long").alias("ms"), F.lit(seq).cast("long").alias("seq"))
    if how in ("le", "lt"):
        return rows.filter(at <= mark if how == "le" else at < mark)
    start = rows.filter(at >= mark if how == "ge" else at > mark).groupBy("key").agg(F.min(at).alias("from"))
    return rows.join(start, "key").filter(at <= F.col("from")).drop("from")


def map_edit(rows: DataFrame, put: DataFrame, remove: DataFrame) -> DataFrame:
    """An ordered map (key, name, value) once entries are put, replacing those of their names, and names removed."""
    kept = rows.join(put.select("key", "name"), ["key", "name"], "left_anti").select("key", "name", "value").union(put.select("key", "name", "value"))
    return kept.join(remove.select("key", "name"), ["key", "name"], "left_anti")


def map_find(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, name, value) of every probe, null where there is none."""
    return probes.select("key", "name").join(rows.select("key", "name", "value"), ["key", "name"], "left")


def map_ends(rows: DataFrame) -> DataFrame:
    """(key, first, last): least and greatest names by their bytes."""
    return rows.groupBy("key").agg(F.min("name").alias("first"), F.max("name").alias("last"))


def map_walk(rows: DataFrame, backward: bool = False) -> DataFrame:
    """(key, place, name, value) in the order of names."""
    order = F.col("name").desc() if backward else F.col("name").asc()
    return rows.withColumn("place", (F.row_number().over(W.partitionBy("key").orderBy(order)) - 1).cast("long")).select("key", "place", "name", "value")


# --- SORT ---


NOT_A_NUMBER = "One or more scores can't be converted into double"


def sort_errors(elements: DataFrame) -> DataFrame:
    """(key, error) of collections (key, elem) that do not sort by number."""
    from tessera.functions.scalars import strict_double

    bad = strict_double(F.col("elem").cast("string")).isNull() & F.col("elem").isNotNull()
    return elements.filter(bad).select("key", F.lit(NOT_A_NUMBER).alias("error")).distinct()


def sort_store(lists: DataFrame, found: DataFrame, name: Column) -> DataFrame:
    """``lists`` (key, pos, elem) with the elements of ``sort_elements`` (key, place, elem) stored under ``name``, an expression over its key; what was there goes, and an empty result leaves nothing."""
    from tessera.operators.keys import dealt

    stored = found.select(name.alias("key"), F.col("place").alias("pos"), "elem", F.lit(1).alias("_new"))
    (rows,) = dealt(lists.select("key", "pos", "elem", F.lit(0).alias("_new")).union(stored))
    # stored elements come first, and only where there are none do old ones stay
    order = W.partitionBy("key").orderBy(F.col("_new").desc(), "pos")
    rows = rows.select("key", (F.row_number().over(order) - 1).cast("long").alias("pos"), "elem", "_new", F.first("_new").over(order).alias("_top"))
    return rows.filter("_new = _top").select("key", "pos", "elem")


def sort_elements(
    elements: DataFrame, *, by: str | None = None, lookup: DataFrame | None = None, get: tuple[str, ...] = (), alpha: bool = False, desc: bool = False, offset: int = 0, count: int = -1,
) -> DataFrame:
    """(key, place, elem, get_0, ...) of each collection's elements (key, elem), in order.

    ``by`` and ``get`` are patterns in which ``*`` stands for the element, looked up as ``name`` or ``name->field`` in ``lookup`` (key, field, value; field null for strings); ``#`` gets the element itself.
    Weights that are no numbers are an error unless ``alpha`` is set (``sort_errors`` has the keys concerned). Missing weights are 0, or come first with ``alpha``; ties go by the element's bytes; ``desc`` turns the whole order round. A ``by`` without ``*`` leaves the elements unsorted (here: in byte order). A negative count runs to the end.
    """
    from tessera.functions.scalars import strict_double

    def look(rows: DataFrame, pattern: str, name: str) -> DataFrame:
        if pattern == "#":
            return rows.withColumn(name, F.col("elem"))
        base, _, field = pattern.partition("->")
        table = lookup.filter(F.col("field") == field if field else F.col("field").isNull()).select(F.col("key").alias("_k"), F.col("value").alias(name))
        before, star, behind = base.partition("*")
        at = F.concat(F.lit(before), F.col("elem"), F.lit(behind)) if star else F.lit(base)
        return rows.join(table, at == F.col("_k"), "left").drop("_k")

    rows = elements.select("key", F.col("elem").cast("string").alias("elem"))
    order = []
    if by is None:
        rows = rows.withColumn("_w", F.col("elem"))
    elif "*" in by:
        rows = look(rows, by, "_w")
    if by is None or "*" in by:
        number = strict_double(F.col("_w"))
        weight = F.col("_w") if alpha else F.when(F.col("_w").isNull(), F.lit(0.0)).when(number.isNull(), F.raise_error(F.lit(NOT_A_NUMBER)).cast("double")).otherwise(number)
        order = [weight.desc_nulls_last() if desc else weight.asc_nulls_first()]
    order.append(F.col("elem").desc() if desc and order else F.col("elem").asc())
    rows = rows.withColumn("place", (F.row_number().over(W.partitionBy("key").orderBy(*order)) - 1).cast("long")).drop("_w")
    rows = rows.filter((F.col("place") >= offset) & (F.lit(count < 0) | (F.col("place") < offset + max(count, 0))))
    for i, pattern in enumerate(get):
        rows = look(rows, pattern, f"get_{i}")
    return rows
