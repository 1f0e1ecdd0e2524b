"""Scores of several methods side by side, and the tables behind plots and maps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .curves import binary_metrics, confusion, curve_points, percentiles, recall_by

CELL = ("tile_id", "year", "window_index")


def side_by_side(labels: DataFrame, methods: dict[str, tuple[DataFrame, str]], keys: Sequence[str] = CELL, year: int | None = None) -> DataFrame:
    """Labels with a column of scores for each method (name: (table, score column)), over the
    cells that all methods score and whose label is known. All joins are on one key, so one
    exchange of each side serves them."""
    out = labels.where(F.col("label").isin(0, 1))
    if year is not None:
        out = out.where(F.col("year") == year)
    for name, (table, score) in methods.items():
        out = out.join(table.select(*keys, F.col(score).alias(name)), list(keys), "left")
    return out.where(reduce(lambda a, b: a & b, (F.col(m).isNotNull() for m in methods)))


def long_form(scored: DataFrame, methods: Sequence[str]) -> DataFrame:
    """A row for each cell and method: (keys, label, method, score)."""
    keep = [c for c in scored.columns if c not in methods]
    return scored.unpivot(keep, list(methods), "method", "score")


def compare(scored: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Metrics of each method; the methods are worked on in parallel."""
    return binary_metrics(long_form(scored, methods), "label", "score", ["method"])


def at_thresholds(scored: DataFrame, methods: Sequence[str]) -> DataFrame:
    """The long form with each method's best-F1 threshold and ``flagged``, score >= threshold."""
    flat = long_form(scored, methods)
    best = binary_metrics(flat, "label", "score", ["method"]).select("method", "best_threshold")
    return flat.join(F.broadcast(best), "method").withColumn("flagged", F.col("score") >= F.col("best_threshold"))  # a row a method


def confusion_panels(scored: DataFrame, methods: Sequence[str]) -> DataFrame:
    """What the confusion plot shows: a row for each method, true class and predicted class."""
    flat = at_thresholds(scored, methods)
    m = confusion(flat, F.col("label") == 1, F.col("flagged"), ["method"])
    cells = F.array(*(F.struct(F.lit(t).alias("true_class"), F.lit(p).alias("predicted_class"), F.col(c).alias("n")) for t, p, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))))
    return m.select("method", F.explode(cells).alias("c")).select("method", "c.*")


def recall_panels(scored: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Recall by method and window at each method's best threshold; null without positives."""
    flat = at_thresholds(scored, methods).withColumn("flag", F.col("flagged").cast("double"))
    return recall_by(flat, "label", "flag", 1.0, ["method", "window_index"])


def map_panels(tiles: DataFrame, scored: DataFrame, values: Sequence[str], key: str = "tile_id") -> DataFrame:
    """Maps side by side: a row for each panel and tile (null where it has no value), with the
    panel's colour range from the exact 5 to 95 percentile."""
    flat = scored.select(key, F.explode(F.array(*(F.struct(F.lit(v).alias("panel"), F.col(v).cast("double").alias("value")) for v in values))).alias("_p")).select(key, "_p.*")
    panels = tiles.select(F.explode(F.array(*(F.lit(v) for v in values))).alias("panel"), "*")
    return panels.join(flat, ["panel", key], "left").join(F.broadcast(clip_range(flat, "value", by=["panel"])), "panel", "left")  # a row a panel


def plot_tables(scored: DataFrame, methods: Sequence[str], thresholds: dict[str, float]) -> dict[str, DataFrame]:
    """What the plots show: curve points, and recall by window at each method's threshold."""
    flat = long_form(scored, methods)
    recalls = [recall_by(flat.where(F.col("method") == m), "label", "score", t, ["method", "window_index"]) for m, t in thresholds.items()]
    return {"curves": curve_points(flat, "label", "score", ["method"]), "recall_by_window": reduce(DataFrame.unionByName, recalls)}


def flag_counts(scored: DataFrame, score: str, threshold: float, by: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Windows at or over the threshold, a tile; rows of unknown label count, too."""
    return scored.groupBy(*by).agg(F.coalesce(F.sum((F.col(score) >= threshold).cast("long")), F.lit(0)).alias("n_flagged"))


def clip_range(df: DataFrame, value: str, low: float = 0.05, high: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles, linear between ranks, nulls skipped."""
    return percentiles(df, value, {"low": low, "high": high}, by)


def map_table(tiles: DataFrame, values: DataFrame, key: str = "tile_id") -> DataFrame:
    """All tiles with their values, null where there are none."""
    return tiles.join(values, key, "left")


def metrics_document(metrics: DataFrame) -> DataFrame:
    """One row of JSON: method -> metric -> number."""
    inner = F.struct(*(c for c in metrics.columns if c != "method"))
    return metrics.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", inner.alias("m")))))).alias("document"))
