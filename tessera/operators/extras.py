"""Bitmaps, cardinality sketches, geography and string edits: our own additions over the same tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the sphere's radius in metres.
EARTH_M = 6372797.560856
#: 2**14 registers.
SKETCH_BITS = 14


def bit_summary(numbers: DataFrame, value: str = "value") -> DataFrame:
    """(key, ones, highest) of the bitmap whose set bits are the numbers of each key."""
    return numbers.groupBy("key").agg(F.count_distinct(value).alias("ones"), F.max(value).alias("highest"))


def bit_combine(numbers: DataFrame, left: str, right: str, how: str) -> DataFrame:
    """Bits (value) of AND, OR, XOR or DIFF of two keys' bitmaps."""
    got = numbers.filter(F.col("key").isin(left, right)).groupBy("value").agg(F.max(F.col("key") == left).alias("l"), F.max(F.col("key") == right).alias("r"))
    test = {"and": F.col("l") & F.col("r"), "or": F.col("l") | F.col("r"), "xor": F.col("l") != F.col("r"), "diff": F.col("l") & ~F.col("r")}[how]
    return got.filter(test).select("value")


def cardinality(rows: DataFrame, column: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_sketch_agg(column, SKETCH_BITS)).alias("n"))


def distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance by haversines."""
    u, v = F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return 2 * EARTH_M * F.asin(F.sqrt(u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v))


def geo_search(points: DataFrame, lon: float, lat: float, radius_m: float) -> DataFrame:
    """Points (member, lon, lat) within a radius, with their distances; a latitude band, which scans can push down, comes first."""
    import math

    band = math.degrees(radius_m / EARTH_M)
    near = points.filter(F.col("lat").between(lat - band, lat + band))
    return near.withColumn("metres", distance_m(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat"))).filter(F.col("metres") <= radius_m)


def get_range(text: Column, start: int, stop: int) -> Column:
    """Bytes start to stop of a value, both included; negative ones count from the end."""
    data = text.cast("binary")
    n = F.octet_length(data)
    a = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    b = F.least(F.lit(stop) if stop >= 0 else n + stop, n - 1)
    return F.when(b >= a, F.substr(data, a + 1, b - a + 1)).otherwise(F.lit(b""))


def increment(log: DataFrame) -> DataFrame:
    """(key, value) after the increments (key, by) of a log."""
    return log.groupBy("key").agg(F.try_sum("by").alias("value"))
