"""Vectors as arrays, in double precision, with higher-order functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if either is missing. The guard is added to the product of the norms, so
    a zero vector is at distance 1."""
    return F.when(a.isNotNull() & b.isNotNull(), 1.0 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + EPSILON))


def normalise(v: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std for each element; a missing or non-finite one counts as its mean."""
    known = F.zip_with(v, mean, lambda x, m: F.coalesce(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x.cast("double")), m.cast("double")) - m.cast("double"))
    return F.zip_with(known, std, lambda x, s: x / s.cast("double"))


def mean_vector(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Rows (keys, mean_vector, n): element-wise means by key. Partial sums are combined by key
    and element before the shuffle, so a hot key costs one row an element and task."""
    parts = df.where(F.col(vector).isNotNull()).select(*keys, F.posexplode(vector).alias("_i", "_x"))
    means = parts.groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.count("_x").alias("_n"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("mean_vector"), F.max("_n").alias("n"))
