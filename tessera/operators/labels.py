"""Cells, their history and anomaly labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import stress_label, z_score

CELL = ("tile_id", "year", "window_index")


def cell_medians(pixels: DataFrame, valid: Column, values: dict[str, Column], keys: Sequence[str] = CELL, pixels_per_cell: int | None = None) -> DataFrame:
    """Exact medians over each cell's valid pixels (null if none), and the valid fraction of
    ``pixels_per_cell`` (of the rows present if not given)."""
    kept = [F.median(F.when(valid, v)).alias(k) for k, v in values.items()]
    whole = F.lit(float(pixels_per_cell)) if pixels_per_cell else F.count(F.lit(1))
    return pixels.groupBy(*keys).agg(*kept, (F.count_if(valid) / whole).alias("valid_fraction"))


def history_stats(cells: DataFrame, value: str, years: tuple[int, int], keys: Sequence[str] = ("tile_id", "window_index")) -> DataFrame:
    """Mean, sample deviation and count of a value over the history years, by tile and window."""
    past = cells.where(F.col("year").between(*years))
    return past.groupBy(*keys).agg(F.avg(value).alias("history_mean"), F.stddev_samp(value).alias("history_std"), F.count(value).alias("history_count"))


def label_cells(cells: DataFrame, value: str = "ndvi", years: tuple[int, int] = (2017, 2023), threshold: float = -1.5, digits: int | None = None) -> DataFrame:
    """Adds history_mean, history_std, history_count, z and label. One shuffle, by tile and
    window, which holds a few years of rows each: the history is a window aggregate, not a join."""
    own = Window.partitionBy("tile_id", "window_index")
    past = F.when(F.col("year").between(*years), F.col(value))
    out = cells.withColumns({"history_mean": F.avg(past).over(own), "history_std": F.stddev_samp(past).over(own), "history_count": F.count(past).over(own)})
    z = z_score(F.col(value), F.col("history_mean"), F.col("history_std"))
    out = out.withColumn("z", F.round(z, digits) if digits is not None else z)
    return out.withColumn("label", stress_label(F.col(value), F.col("z"), threshold))


def summarise(labelled: DataFrame, by: Sequence[str] = ("window_index",), value: str = "ndvi") -> DataFrame:
    return labelled.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("stressed"), F.avg(value).alias("mean_value"), F.avg("z").alias("mean_z"))
