"""Drought agreement and causes of stress: lookbacks, neighbours, flags and categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio_or_zero
from .curves import binary_metrics, confusion

CELL = ("tile_id", "year", "window_index")
# The categories, by priority.
CATEGORIES = ("flood", "climatic_event_or_frost", "local_field", "drought", "other_unknown")


def lookback(cells: DataFrame, value: str, steps: int = 2, chronological: str | None = None) -> DataFrame:
    """Adds drop_recent: the value ``steps`` windows before, minus the current one; null if that
    window is absent. By value of window_index, not by rows. With ``chronological``, the name of a
    column with the windows' order in time, that is used instead."""
    order = Window.partitionBy("tile_id", "year").orderBy(chronological or "window_index")
    return cells.withColumn("drop_recent", F.first(value).over(order.rangeBetween(-steps, -steps)) - F.col(value))


def stressed_neighbours(labelled: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds n_stressed_neighbours for each cell (0 without any). Only stressed cells travel along
    the edges, and they are counted before they meet the cells."""
    stressed = labelled.where(F.col("label") == 1).select(F.col("tile_id").alias("nbr_id"), "year", "window_index")
    counts = stressed.join(edges, "nbr_id").groupBy("tile_id", "year", "window_index").agg(F.count(F.lit(1)).alias("n_stressed_neighbours"))
    return labelled.join(counts, list(CELL), "left").withColumn("n_stressed_neighbours", F.coalesce("n_stressed_neighbours", F.lit(0)))


def categorise(cells: DataFrame, drought: str = "usdm_class", radar: str = "vv_db", drop: str = "drop_recent", neighbours: str = "n_stressed_neighbours", min_drought: int = 2, flood_below: float = -20.0, sudden_above: float = 0.30, isolated_below: int = 2) -> DataFrame:
    """Adds is_drought, is_flooded, is_sudden, is_isolated (an unknown value: false, an unknown
    neighbour count: isolated) and the category."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    out = cells.withColumns({
        "is_drought": F.coalesce(F.col(drought), F.lit(-1)) >= min_drought,
        "is_flooded": flag(F.col(radar) < flood_below),
        "is_sudden": flag(F.col(drop) > sudden_above),
        "is_isolated": F.coalesce(F.col(neighbours), F.lit(0)) < isolated_below,
    })
    sudden, isolated = F.col("is_sudden"), F.col("is_isolated")
    return out.withColumn("category", F.when(F.col("is_flooded"), CATEGORIES[0]).when(sudden & ~isolated, CATEGORIES[1]).when(sudden & isolated, CATEGORIES[2]).when(F.col("is_drought"), CATEGORIES[3]).otherwise(CATEGORIES[4]))


def category_counts(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of each category, in columns, 0 where there are none."""
    return cells.groupBy(*by).agg(*(F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES))


def drought_agreement(cells: DataFrame, label: str = "label", drought: str = "usdm_class", score: str = "score", min_drought: int = 2) -> DataFrame:
    """One row: how stress labels agree with drought classes. The confusion counts all known
    labels, an unknown class being no drought; both readings are given, labels as truth and
    drought as truth, with names that say which. The AUC is over cells with a class only."""
    known = cells.where(F.col(label).isin(0, 1))
    dry = F.coalesce(F.col(drought), F.lit(-1)) >= min_drought
    m = confusion(known, F.col(label) == 1, dry)
    out = m.select(
        "tp", "fp", "fn", "tn",
        F.col("precision").alias("drought_precision_of_labels"), F.col("recall").alias("drought_recall_of_labels"),
        ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fn")).alias("label_precision_of_drought"), ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp")).alias("label_recall_of_drought"), "f1",
    )
    inside = known.where(F.col(drought).isNotNull()).select((F.col(drought) >= min_drought).cast("int").alias("_y"), F.col(score).alias("_s"))
    return out.crossJoin(F.broadcast(binary_metrics(inside, "_y", "_s").select("roc_auc")))  # one row each


def radar_medians(pixels: DataFrame, radar, keys: Sequence[str] = CELL) -> DataFrame:
    """Median of the known radar values of a cell; null if there are none."""
    return pixels.groupBy(*keys).agg(F.median(radar).alias("vv_db"))
