"""Tiles, neighbours and polygons. Spatial joins are equi-joins on grid keys wherever they can be."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import distance, snap_down


def tile_grid(spark: SparkSession, bounds: tuple[float, float, float, float], size: float = 5120.0) -> DataFrame:
    """Square tiles that cover the bounds, numbered by column and then row from 1."""
    x0, y0 = math.floor(bounds[0] / size) * size, math.floor(bounds[1] / size) * size
    nx, ny = math.ceil((bounds[2] - x0) / size), math.ceil((bounds[3] - y0) / size)
    n = spark.range(nx * ny)
    return n.select((F.col("id") + 1).alias("tile_id"), (F.expr(f"id div {ny}") * size + x0).alias("x0"), ((F.col("id") % ny) * size + y0).alias("y0")).withColumns({"x1": F.col("x0") + size, "y1": F.col("y0") + size})


def grid_key(x: Column, y: Column, size: float) -> Column:
    return F.struct(F.floor(x / size).cast("long").alias("gx"), F.floor(y / size).cast("long").alias("gy"))


def points_in_tiles(points: DataFrame, tiles: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Points with the tile that holds them (lower edges belong to a tile): a range join as an
    equi-join on the grid key, since tiles sit on the grid."""
    keyed = tiles.select("tile_id", grid_key(F.col("x0"), F.col("y0"), size).alias("_k"))
    return points.withColumn("_k", grid_key(F.col(x), F.col(y), size)).join(keyed, "_k").drop("_k")


def neighbour_edges(tiles: DataFrame, radius: float, nearest: float = 1.0, ident: str = "tile_id", x: str = "x", y: str = "y") -> DataFrame:
    """(tile_id, nbr_id) with nearest < distance <= radius. Each tile goes to the nine buckets of
    the radius's size around it; only tiles that meet in a bucket are compared."""
    spot = tiles.select(F.col(ident).alias("_id"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.floor(F.col(x) / radius).cast("long").alias("_bx"), F.floor(F.col(y) / radius).cast("long").alias("_by"))
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    sent = spot.withColumn("_s", F.explode(around)).select(F.col("_id").alias("nbr_id"), F.col("_x").alias("_nx"), F.col("_y").alias("_ny"), (F.col("_bx") + F.col("_s.i")).alias("_bx"), (F.col("_by") + F.col("_s.j")).alias("_by"))
    d = distance(F.col("_x"), F.col("_y"), F.col("_nx"), F.col("_ny"))
    return spot.join(sent, ["_bx", "_by"]).where((d > nearest) & (d <= radius)).select(F.col("_id").alias(ident), "nbr_id")


def _edges(ring: Column) -> Column:
    """Each corner with the next, the last with the first."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, (i + 1) % n).alias("b")))


def _crossed(px: Column, py: Column, e: Column) -> Column:
    a, b = e["a"], e["b"]
    return ((a["y"] > py) != (b["y"] > py)) & F.when(a["y"] != b["y"], px < (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"]).otherwise(False)


def _on(px: Column, py: Column, e: Column) -> Column:
    a, b = e["a"], e["b"]
    side = (b["x"] - a["x"]) * (py - a["y"]) - (b["y"] - a["y"]) * (px - a["x"])
    return (side == 0) & px.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & py.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


def in_polygon(px: Column, py: Column, ring: Column) -> Column:
    """Whether a point is in a ring (array of struct<x, y>, closed or not) or on its edge, by
    counting crossings; no Python."""
    return (F.size(F.filter(_edges(ring), lambda e: _crossed(px, py, e))) % 2 == 1) | F.exists(_edges(ring), lambda e: _on(px, py, e))


def in_rings(px: Column, py: Column, rings: Column) -> Column:
    """Whether a point is in the area that all rings of a record bound together (an array of rings:
    outer ones, holes, several parts): an odd number of them holds it; or on the edge of one."""
    one = lambda ring: F.size(F.filter(_edges(ring), lambda e: _crossed(px, py, e)))
    return (F.aggregate(rings, F.lit(0), lambda n, r: n + one(r)) % 2 == 1) | F.exists(rings, lambda r: F.exists(_edges(r), lambda e: _on(px, py, e)))


def _many(df: DataFrame, shape: str) -> bool:
    """Whether a geometry column has several rings a row, or one."""
    return isinstance(df.schema[shape].dataType.elementType, T.ArrayType)


def _as_rings(df: DataFrame, shape: str) -> Column:
    return F.col(shape) if _many(df, shape) else F.array(F.col(shape))


def _coordinates(df: DataFrame, shape: str) -> tuple[Column, Column]:
    points = F.flatten(_as_rings(df, shape))
    return F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])


def bounds(polygons: DataFrame, ring: str = "ring", by: Sequence[str] = ()) -> DataFrame:
    """The box of each group's polygons; ``ring`` has one ring a row, or an array of rings."""
    xs, ys = _coordinates(polygons, ring)
    return polygons.groupBy(*by).agg(F.min(F.array_min(xs)).alias("min_x"), F.min(F.array_min(ys)).alias("min_y"), F.max(F.array_max(xs)).alias("max_x"), F.max(F.array_max(ys)).alias("max_y"))


def _moments(rings: Column) -> Column:
    """struct<a, x, y>: twice the signed area, and six times the area's moments, of all rings."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(s: Column, e: Column) -> Column:
        c = e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
        return F.struct((s["a"] + c).alias("a"), (s["x"] + (e["a"]["x"] + e["b"]["x"]) * c).alias("x"), (s["y"] + (e["a"]["y"] + e["b"]["y"]) * c).alias("y"))

    return F.aggregate(F.flatten(F.transform(rings, _edges)), zero, step)


def area(rings: Column) -> Column:
    """Of an array of rings whose holes run the other way round than what they are holes of, as
    files keep them and ``union_polygons`` gives them."""
    return F.abs(_moments(rings)["a"]) / 2


def centroid(rings: Column) -> Column:
    """struct<x, y>, by area; null for rings without one."""
    m = _moments(rings)
    scale = F.nullif(3 * m["a"], F.lit(0.0))
    return F.when(scale.isNotNull(), F.struct((m["x"] / scale).alias("x"), (m["y"] / scale).alias("y")))


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float, *, order: Sequence[Column], x: str = "x", y: str = "y", point_id: str = "point_id", ring: str = "ring") -> DataFrame:
    """A left join of points with the first polygon (in ``order``) that holds them; ``ring`` is a
    ring or an array of rings (holes and parts). A polygon goes to the grid cells its box meets; a
    point to its own; only these pairs are tested.

    Defined cases: a point with a null id or coordinate, and one in no polygon, has nulls; a polygon
    without points is in none; points that repeat an id get the first polygon that holds any of
    them; a polygon's column that has the name of a point's is given as ``polygon_<name>``.
    """
    cols = [c for c in polygons.columns if c != ring]
    xs, ys = _coordinates(polygons, ring)
    cells = lambda v: F.sequence(F.floor(F.array_min(v) / size).cast("long"), F.floor(F.array_max(v) / size).cast("long"))
    shapes = polygons.select(F.struct(*cols).alias("_poly"), _as_rings(polygons, ring).alias("_rings"), cells(xs).alias("_xs"), cells(ys).alias("_ys"), F.struct(*order).alias("_order"))
    shapes = shapes.withColumn("_gx", F.explode("_xs")).withColumn("_gy", F.explode("_ys")).drop("_xs", "_ys")
    spots = points.select(F.col(point_id).alias("_pid"), F.col(x).alias("_px"), F.col(y).alias("_py"), F.floor(F.col(x) / size).cast("long").alias("_gx"), F.floor(F.col(y) / size).cast("long").alias("_gy"))
    hits = spots.join(shapes, ["_gx", "_gy"]).where(in_rings(F.col("_px"), F.col("_py"), F.col("_rings")))
    first = hits.groupBy("_pid").agg(F.min_by("_poly", "_order").alias("_poly"))
    named = [F.col("_poly")[c].alias(f"polygon_{c}" if c in points.columns else c) for c in cols]
    return points.join(first, points[point_id] == first["_pid"], "left").select(*(points[c] for c in points.columns), *named)


def tiles_in_polygons(tiles: DataFrame, polygons: DataFrame, size: float, ring: str = "ring") -> DataFrame:
    """A semi join: the tiles (x0, y0, x1, y1; on a grid of ``size``) that meet any polygon: a corner
    in it, or an edge of it in the tile. A polygon goes to the grid cells its box meets. A tile inside
    a hole does not meet it."""
    xs, ys = _coordinates(polygons, ring)
    cells = lambda v: F.sequence(F.floor(F.array_min(v) / size).cast("long") - 1, F.floor(F.array_max(v) / size).cast("long"))
    shapes = polygons.select(_as_rings(polygons, ring).alias("_rings"), F.explode(cells(xs)).alias("_gx"), cells(ys).alias("_ys")).select("_rings", "_gx", F.explode("_ys").alias("_gy"))
    keyed = tiles.withColumns({"_gx": F.floor(F.col("x0") / size).cast("long"), "_gy": F.floor(F.col("y0") / size).cast("long")})
    corner = lambda a, b: in_rings(F.col(a), F.col(b), F.col("_rings"))
    edge = F.exists(F.flatten(F.transform("_rings", _edges)), lambda e: _meets_box(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))
    meets = corner("x0", "y0") | corner("x0", "y1") | corner("x1", "y0") | corner("x1", "y1") | edge
    return keyed.join(shapes, ["_gx", "_gy"]).where(meets).select(*tiles.columns).distinct()


def clip_to_polygons(pixels: DataFrame, polygons: DataFrame, size: float, x: str = "x", y: str = "y", ring: str = "ring") -> DataFrame:
    """The pixels whose centres are in any polygon; a pixel goes to one grid cell, a polygon to those
    its box meets."""
    xs, ys = _coordinates(polygons, ring)
    cells = lambda v: F.sequence(F.floor(F.array_min(v) / size).cast("long"), F.floor(F.array_max(v) / size).cast("long"))
    shapes = polygons.select(_as_rings(polygons, ring).alias("_rings"), F.explode(cells(xs)).alias("_gx"), cells(ys).alias("_ys")).select("_rings", "_gx", F.explode("_ys").alias("_gy"))
    keyed = pixels.withColumns({"_gx": F.floor(F.col(x) / size).cast("long"), "_gy": F.floor(F.col(y) / size).cast("long")})
    near = shapes.groupBy("_gx", "_gy").agg(F.collect_list("_rings").alias("_shapes"))  # the polygons that meet a cell
    held = keyed.join(near, ["_gx", "_gy"]).where(F.exists("_shapes", lambda r: in_rings(F.col(x), F.col(y), r)))
    return held.select(*pixels.columns)


def tiles_in_polygon(tiles: DataFrame, ring: Sequence[tuple[float, float]]) -> DataFrame:
    """Tiles that meet one polygon: a corner of either in the other, or edges that cross."""
    shape = F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ring))
    corner = lambda x, y: in_polygon(F.col(x), F.col(y), shape)
    meets = corner("x0", "y0") | corner("x0", "y1") | corner("x1", "y0") | corner("x1", "y1")
    closed = list(ring) + [ring[0]]
    for (ax, ay), (bx, by) in zip(closed, closed[1:]):
        meets = meets | _meets_box(*(F.lit(float(v)) for v in (ax, ay, bx, by)))
    return tiles.where(meets)


def _meets_box(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Separating axes: the boxes overlap and the corners are not all on one side of the line."""
    box = (F.col("x0") <= F.greatest(ax, bx)) & (F.col("x1") >= F.least(ax, bx)) & (F.col("y0") <= F.greatest(ay, by)) & (F.col("y1") >= F.least(ay, by))
    side = lambda x, y: (bx - ax) * (F.col(y) - ay) - (by - ay) * (F.col(x) - ax)
    s = [side(x, y) for x in ("x0", "x1") for y in ("y0", "y1")]
    return box & (F.least(*s) <= 0) & (F.greatest(*s) >= 0)


def snapped_origin(x: Column, y: Column, size: float) -> Column:
    return F.struct(snap_down(x, size).alias("x0"), snap_down(y, size).alias("y0"))
