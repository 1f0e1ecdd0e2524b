"""Exact curve metrics: ROC AUC with ties, average precision, best-F1 threshold, curve points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import f1, ratio_or_zero
from ..session import shared_path

RANGE_ROWS = 100_000  # distinct scores of a group that are sorted in one task
MAX_RANGES = 1024  # of a group; their edges are an array in its rows


def _keyed(df: DataFrame, by: Sequence[str], **columns) -> DataFrame:
    """The group's columns as one struct, and the columns that are needed under names of our own, so
    that none can clash."""
    return df.select(F.struct(*by).alias("_g") if by else F.lit(0).alias("_g"), *(c.alias(k) for k, c in columns.items()))


def _ungrouped(by: Sequence[str]):
    return [F.col("_g")[c].alias(c) for c in by]


def _curve(df: DataFrame, label: str, score: str, by: Sequence[str], range_rows: int) -> DataFrame:
    rows = _keyed(df, by, _y=F.col(f"`{label}`").cast("long"), score=F.col(f"`{score}`").cast("double")).where("_y is not null and score is not null")
    points = rows.groupBy("_g", "score").agg(F.sum("_y").alias("p"), F.count(F.lit(1)).alias("n"))
    path = shared_path(df.sparkSession, "curve")
    points.write.parquet(path)
    points = df.sparkSession.read.schema(points.schema).parquet(path)
    # Each group has as many ranges as its distinct scores need, cut at its own quantiles.
    sizes = points.groupBy("_g").agg(F.count(F.lit(1)).alias("_c"), F.min("score").alias("_low"), F.max("score").alias("_high"), F.approx_percentile("score", F.array(*(F.lit(i / MAX_RANGES) for i in range(1, MAX_RANGES))), 10_000).alias("_q"))
    parts = F.least(F.lit(MAX_RANGES), F.ceil(F.col("_c") / range_rows)).cast("int")
    edges = F.when(parts <= 1, F.array().cast("array<double>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(parts - 1, F.lit(1))), lambda i: F.get("_q", (i * MAX_RANGES / parts).cast("int") - 1))))
    cuts = sizes.select(F.col("_g").alias("_cg"), edges.alias("_edges"))
    ranged = points.join(cuts, F.col("_g").eqNullSafe(F.col("_cg"))).select("_g", "score", "p", "n", F.size(F.filter("_edges", lambda e: F.col("score") < e)).alias("_b"))
    sums = ranged.groupBy("_g", "_b").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    group = Window.partitionBy("_g")  # a few ranges a group
    above = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_g").alias("_sg"), F.col("_b").alias("_bb"), F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p0"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n0"), F.sum("_p").over(group).alias("pos"), F.sum("_n").over(group).alias("total"))
    run = Window.partitionBy("_g", "_b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(sums, F.col("_g").eqNullSafe(F.col("_sg")) & (F.col("_b") == F.col("_bb"))).withColumn("tp", F.col("_p0") + F.sum("p").over(run)).withColumn("pp", F.col("_n0") + F.sum("n").over(run)).select("_g", "score", "p", "n", "tp", "pp", "pos", "total")


def curve(df: DataFrame, label: str, score: str, by: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows (by, score, p, n, tp, pp, pos, total): at each distinct score, the positives and rows
    there, and those at or above it.

    Rows are combined by score first, and written, as they are read more than once. The running
    sums would put each group in one task, so scores are dealt into ranges of about ``range_rows``
    (at most 1024 a group); sums of whole ranges, a few rows, are run up first. Rows without a label
    or a score are left out; a null group is a group; an empty table gives an empty one. Groups may
    have any names but those of the result's own columns.
    """
    return _curve(df, label, score, by, range_rows).select(*_ungrouped(by), "score", "p", "n", "tp", "pp", "pos", "total")


def curve_points(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC and precision-recall points at each distinct score."""
    c = _curve(df, label, score, by, RANGE_ROWS)
    neg = F.col("total") - F.col("pos")
    return c.select(*_ungrouped(by), "score", F.try_divide(F.col("pp") - F.col("tp"), neg).alias("fpr"), F.try_divide("tp", "pos").alias("tpr"), (F.col("tp") / F.col("pp")).alias("precision"))


def binary_metrics(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """A row a group: n, positives, roc_auc, average_precision, best_threshold, best_f1, and the
    precision and recall there. AUC and AP are null if a group has one class only; of equal F1
    the lowest threshold is taken."""
    c = _curve(df, label, score, by, RANGE_ROWS)
    neg, tp, pp, p, n, pos = F.col("total") - F.col("pos"), F.col("tp"), F.col("pp"), F.col("p"), F.col("n"), F.col("pos")
    precision, recall = tp / pp, F.try_divide(tp, pos)
    c = c.withColumn("_auc", F.try_divide(n - p, neg) * ((tp - p) + tp) / 2 / F.nullif(pos, F.lit(0))).withColumn("_ap", F.try_divide(p, pos) * precision)
    c = c.withColumn("_f", F.round(f1(precision, F.coalesce(recall, F.lit(0.0))), 12)).withColumn("_pr", precision).withColumn("_re", F.coalesce(recall, F.lit(0.0)))
    best = F.max(F.struct("_f", (-F.col("score")).alias("_s"), "_pr", "_re"))
    out = c.groupBy(*(["_g"] if by else [])).agg(F.max("total").alias("n"), F.max("pos").alias("positives"), F.sum("_auc").alias("roc_auc"), F.sum("_ap").alias("average_precision"), best.alias("_best"))
    two = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    return out.select(*_ungrouped(by), "n", "positives", F.when(two, F.col("roc_auc")).alias("roc_auc"), F.when(F.col("positives") > 0, F.col("average_precision")).alias("average_precision"), (-F.col("_best._s")).alias("best_threshold"), F.col("_best._f").alias("best_f1"), F.col("_best._pr").alias("precision"), F.col("_best._re").alias("recall"))


def percentiles(df: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles by group, linear between ranks, nulls skipped; a column for each name. Rows
    are combined by value and ranked by range, so a group needs no task that holds its values. A group
    without values has no row."""
    c = _curve(df.withColumn("_zero", F.lit(0)), "_zero", value, by, RANGE_ROWS)
    first, behind = F.col("total") - F.col("pp"), F.col("total") - F.col("pp") + F.col("n")  # its ranks, from 0
    found = []
    for i, share in enumerate(shares.values()):
        rank = F.lit(float(share)) * (F.col("total") - 1)
        for name, k in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            found.append(F.max(F.when((first <= k) & (k < behind), F.col("score"))).alias(f"_{name}{i}"))
    m = c.groupBy("_g").agg(F.max("total").alias("_n"), *found)
    part = [F.lit(float(p)) * (F.col("_n") - 1) for p in shares.values()]
    return m.select(*_ungrouped(by), *((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (r - F.floor(r))).alias(name) for i, (name, r) in enumerate(zip(shares, part))))


def confusion(df: DataFrame, truth, predicted, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn with precision, recall and F1 (0 where undefined). truth, predicted:
    boolean columns."""
    m = _keyed(df, by, _t=truth, _y=predicted).groupBy(*(["_g"] if by else [])).agg(F.count_if(F.col("_t") & F.col("_y")).alias("tp"), F.count_if(~F.col("_t") & F.col("_y")).alias("fp"), F.count_if(F.col("_t") & ~F.col("_y")).alias("fn"), F.count_if(~F.col("_t") & ~F.col("_y")).alias("tn"))
    m = m.withColumn("precision", ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fn")))
    m = m.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    return m.select(*_ungrouped(by), "tp", "fp", "fn", "tn", "precision", "recall", "f1")


def recall_by(df: DataFrame, label: str, score: str, threshold: float, by: Sequence[str]) -> DataFrame:
    """Recall at a threshold by group; null where a group has no positives."""
    pos = F.col(label) == 1
    return df.groupBy(*by).agg(F.count_if(pos).alias("positives"), F.try_divide(F.count_if(pos & (F.col(score) >= threshold)), F.count_if(pos)).alias("recall"))


def class_balance(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, positives, prevalence and the weight that makes positives count like negatives."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.groupBy(*by).agg((pos + neg).alias("n"), pos.alias("positives"), F.try_divide(pos, pos + neg).alias("prevalence"), (F.greatest(neg, F.lit(1)) / F.greatest(pos, F.lit(1))).alias("pos_weight"))
