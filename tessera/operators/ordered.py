"""Ordered and set operators that the stages use here and there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_path


def mid_rank(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Adds mid_rank: the mean of the ranks that equal values share."""
    group = Window.partitionBy(*by)
    return df.withColumn("mid_rank", F.rank().over(group.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2)


def best_so_far(df: DataFrame, value: str, order: str, by: Sequence[str]) -> DataFrame:
    """Adds best (the running maximum) and is_best (whether this row raises it)."""
    run = Window.partitionBy(*by).orderBy(order)
    before = F.max(value).over(run.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("best", F.max(value).over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("is_best", F.coalesce(F.col(value) > before, F.lit(True)))


def first_of_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key, in an order that must be given. A minimum of structs, combined
    before the shuffle, so a hot key is no burden."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def renumber(df: DataFrame, order: str, name: str = "new_id", start: int = 1) -> DataFrame:
    """Dense numbers in an order; equal values are numbered by a hash of their rows.

    Rows are dealt into ranges and written once with their range, so that counting and numbering see
    the same ranges; only the ranges' counts are added up in one place, and a value that very many
    rows have is split over ranges, too.
    """
    by = [F.col(order), F.xxhash64(*(F.col(c) for c in df.columns))]
    path = shared_path(df.sparkSession, "renumber")
    df.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()).write.parquet(path)
    ranged = df.sparkSession.read.schema(T.StructType([*df.schema, T.StructField("_p", T.IntegerType())])).parquet(path)
    upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))  # a row a range
    marked = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*by)))
    return marked.join(F.broadcast(before), "_p").withColumn(name, (F.col("_before") + F.col("_k") + (start - 1)).cast("long")).drop("_p", "_k", "_before")


def permutation(df: DataFrame, seed: int) -> DataFrame:
    """The rows in a random order that the seed fixes."""
    return df.orderBy(F.xxhash64(*(F.col(c) for c in df.columns), F.lit(seed)), *df.columns)


def missing(wanted: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(df, key, "left_anti")


def require(df: DataFrame, key: str, values: Sequence) -> DataFrame:
    """The rows of the wanted keys; raises if a key has none."""
    found = df.where(F.col(key).isin(*values))
    absent = set(values) - {r[0] for r in found.select(key).distinct().limit(len(values)).collect()}
    if absent:
        raise KeyError(f"no rows for {sorted(absent)}")
    return found


def pivot_first(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, value: str, order: Sequence[Column] = ()) -> DataFrame:
    """A column for each of the given values, with the first known value in ``order`` (null if
    there is none); without an order, as rows have none of their own, the least."""
    first = F.min_by(value, F.struct(*order)) if order else F.min(value)
    return df.where(F.col(value).isNotNull() | F.lit(not order)).groupBy(*keys).pivot(column, list(values)).agg(first)


def head(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows in a stated order; each task keeps n, so nothing is sorted as a whole."""
    return df.orderBy(*order).limit(n)


def summary(df: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A row for each group and value column: n (known values), least, greatest, mean and exact
    median. Clashing names don't matter: the groups' columns come first and keep their names."""
    flat = df.select(*by, F.explode(F.array(*(F.struct(F.lit(v).alias("name"), F.col(f"`{v}`").cast("double").alias("value")) for v in values))).alias("_s"))
    v = F.col("_s.value")
    return flat.groupBy(*by, F.col("_s.name").alias("value_name")).agg(F.count(v).alias("n_known"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.avg(v).alias("mean"), F.median(v).alias("median"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, null among them."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
