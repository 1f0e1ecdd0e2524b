"""Connected components of an edge table, without collecting anything to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _signature(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """From edges (a, b) of longs to rows (node, root), root being the smallest node reachable;
    only nodes that are not roots are returned.

    Large stars and small stars in turn: each round links a node's larger neighbours, then its
    smaller ones, to the smallest node it sees. Smallest neighbours are found by an aggregation
    that is combined before the shuffle and joined back, so a hub's edges are never in one task
    (adaptive execution splits its side of the join). Every round is written to the shared folder.

    Defined cases: repeated edges and edges in both directions count once; an edge from a node to itself
    or with a null end is none; no edges give no rows.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).select("a", "b").distinct(), "edges")
    before = _signature(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("b"), F.col("a")))  # a's neighbour b, both ways
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).withColumnRenamed("a", "u")
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = written(small, "edges")
        if (after := _signature(edges)) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
