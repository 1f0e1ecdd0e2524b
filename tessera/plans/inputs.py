"""The driver's tables in the roles of the stages' inputs.

A line item is a pixel of a tile (its supplier) in a window (the month of its shipping); a supplier
is a tile on a grid ten wide; events are scenes; orders are a work ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import labels as L
from ..session import read_table

HISTORY, SCORED = (1995, 1999), 2000
SIDE = 5120.0


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile_id, year, window_index, row, col, and bands as digital numbers."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("tile_id"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("window_index"), F.dayofmonth("l_shipdate").alias("day"),
        (F.col("l_orderkey") % 40).cast("int").alias("row"), (F.col("l_partkey") % 40).cast("int").alias("col"),
        (F.col("l_tax") * 10000).alias("blue"), (F.col("l_quantity") * 200).alias("red"), (F.col("l_extendedprice") / 10).alias("nir"),
        F.col("l_linenumber").alias("scl"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of a normalised difference for each tile, year and window."""
    p = pixels(spark, sf_dir)
    near, far = F.col("price"), 1500 * F.col("quantity")
    return L.cell_medians(p, F.lit(True), {"ndvi": F.round((near - far) / F.greatest(near + far, F.lit(S.EPSILON)), 9)}).drop("valid_fraction")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.label_cells(cells(spark, sf_dir), years=HISTORY, digits=6)


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("tile_id"), ((F.col("s_suppkey") % 10) * SIDE).alias("x"), (F.expr("s_suppkey div 10") * SIDE).alias("y"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary labels with a score that has ties: doc_id, toxic, quality, score, grp."""
    la, d = read_table(spark, sf_dir, "labels"), read_table(spark, sf_dir, "documents")
    return la.join(d.select("doc_id", F.col("n_chars").cast("double").alias("score"), F.col("source").alias("grp")), "doc_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), "embedding")


#: The same in SQL, as common table expressions.
CELLS = """cells as (select l_suppkey as tile_id, cast(year(l_shipdate) as int) as year, cast(month(l_shipdate) as int) as window_index,
  median(round((l_extendedprice - 1500 * l_quantity) / greatest(l_extendedprice + 1500 * l_quantity, 1e-6), 9)) as ndvi from lineitem group by all)"""
HISTORY_SQL = """hist as (select tile_id, window_index, avg(ndvi) as history_mean, stddev_samp(ndvi) as history_std, count(ndvi) as history_count from cells where year between 1995 and 1999 group by all)"""
LABELLED = f"""{CELLS},
{HISTORY_SQL},
zs as (select c.*, h.history_mean, h.history_std, coalesce(h.history_count, 0) as history_count, round((c.ndvi - h.history_mean) / nullif(h.history_std, 0), 6) as z from cells c left join hist h using (tile_id, window_index)),
labelled as (select *, case when ndvi is null or z is null then -1 when z < -1.5 then 1 else 0 end as label from zs)"""
TILES = """tiles as (select s_suppkey as tile_id, (s_suppkey % 10) * 5120.0::double as x, (s_suppkey // 10) * 5120.0::double as y from supplier)"""
EDGES = """edges as (select a.tile_id, b.tile_id as nbr_id from tiles a, tiles b where sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) > 1 and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 8192)"""
JUDGED = """judged as (select l.doc_id, l.toxic, l.quality, cast(d.n_chars as double) as score, d.source as grp from labels l join documents d using (doc_id))"""
VECTORS = """vecs as (select vec_id, cast(label as int) as label, embedding::double[] as v from embeddings)"""
COSINE = "1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) + 1e-8)"
