"""Rasters as pixel tables: mosaics, zonal statistics, composites and focal means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scene classes that hide the ground, and the floor below which radar has no data.
BAD_SCENE_CLASSES = (0, 1, 3, 8, 9, 10)
RADAR_FLOOR = -32_000.0


def mosaic_max(pixels: DataFrame, code: str = "code", keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Overlapping rasters on one grid: the larger code wins."""
    return pixels.groupBy(*keys).agg(F.max(code).alias(code))


def modal_class(corn: Column, soy: Column, codes: tuple[int, int] = (1, 5)) -> Column:
    """The first class only if it has strictly more; of an equal number above 0, the second."""
    return F.when(corn > soy, codes[0]).when(soy > 0, codes[1]).otherwise(0)


def zonal_fractions(pixels: DataFrame, code: str, classes: dict[str, int], keys: Sequence[str]) -> DataFrame:
    """Each class's share of all pixels of a zone, and the modal one of the first two."""
    shares = [F.avg(F.when(F.col(code) == v, 1.0).otherwise(0.0)).alias(f"{k}_frac") for k, v in classes.items()]
    counts = [F.count_if(F.col(code) == v).alias(f"_{k}") for k, v in classes.items()]
    a, b = list(classes)[:2]
    return pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pixels"), *shares, *counts).withColumn("modal_class", modal_class(F.col(f"_{a}"), F.col(f"_{b}"), (classes[a], classes[b]))).drop(*(f"_{k}" for k in classes))


def clear(scene_class: Column, band: Column) -> Column:
    """The band where the ground is seen, else null; the row stays."""
    return F.when(~scene_class.isin(*BAD_SCENE_CLASSES), band)


def radar(value: Column) -> Column:
    return F.when(value > RADAR_FLOOR, value)


def composite_median(scenes: DataFrame, keys: Sequence[str], bands: dict[str, Column]) -> DataFrame:
    """Per-pixel exact median over time, nulls skipped; 0 where nothing was seen, truncated."""
    return scenes.groupBy(*keys).agg(*(F.coalesce(F.median(b), F.lit(0.0)).cast("int").alias(k) for k, b in bands.items()))


def composite_mean(scenes: DataFrame, keys: Sequence[str], bands: dict[str, Column]) -> DataFrame:
    return scenes.groupBy(*keys).agg(*(F.avg(b).alias(k) for k, b in bands.items()))


def focal_mean(pixels: DataFrame, value: str, size: int = 5, keys: Sequence[str] = (), shape: tuple[int, int] | None = None) -> DataFrame:
    """Mean over a size x size neighbourhood (row, col) in each raster (``keys``: year, window,
    band ...), with the border reflected: before the first row comes the first row again, then the
    second. A missing pixel or value counts as 0; only pixels that are there get a row.

    ``shape`` is the number of rows and columns (at least ``size // 2``); without it a raster ends at
    its last pixel. Two sums, along rows and then columns: a pixel goes to 2 x ``size`` sums, not
    ``size`` squared, and these are combined before each shuffle by (keys, row, col).
    """
    half, keys = size // 2, list(keys)
    if shape:
        sized = pixels.withColumns({"_h": F.lit(shape[0]), "_w": F.lit(shape[1])})
    else:
        edge = pixels.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        sized = pixels.join(edge, on) if keys else pixels.crossJoin(F.broadcast(edge))  # one row

    def summed(df: DataFrame, axis: str, extent: str) -> DataFrame:
        """Adds up, at each place of the axis, the values that its neighbourhood reflects."""
        at, n = F.col(axis), F.col(extent)
        seen_at = F.array_compact(F.array(at, F.when(at < half, -1 - at), F.when(at >= n - half, 2 * n - 1 - at)))
        reach = F.flatten(F.transform(seen_at, lambda m: F.sequence(m - half, m + half)))
        sent = df.withColumn("_to", F.explode(F.filter(reach, lambda o: (o >= 0) & (o < n))))
        other = "col" if axis == "row" else "row"
        sums = sent.groupBy(*keys, other, F.col("_to").alias("_at"), "_h", "_w").agg(F.sum("_v").alias("_v"), F.bool_or(F.col("_own") & (F.col("_to") == at)).alias("_own"))
        return sums.withColumnRenamed("_at", axis)

    flat = sized.select(*keys, "row", "col", "_h", "_w", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v"), F.lit(True).alias("_own"))
    sums = summed(summed(flat, "col", "_w"), "row", "_h")
    return sums.where("_own").select(*keys, "row", "col", (F.col("_v") / float(size * size)).alias(value))


#: The same; its sums have always been separable.
focal_mean_separable = focal_mean


def regrid(blocks: DataFrame, origin: tuple[float, float], pixel: float, shape: tuple[int, int], keys: Sequence[str] = (), value: str = "value", digits: int = 9) -> DataFrame:
    """Pixels with centres x, y dealt to the grid whose upper left corner is ``origin`` (y falls
    with rows): nearest pixel centre, the source pixel nearest to it if several are (squared
    distances to ``digits`` decimals), ties to the smaller x, then y, then value. Pixels outside the grid are left out; places without a pixel have no row."""
    col, row = F.floor((F.col("x") - origin[0]) / pixel).cast("int"), F.floor((origin[1] - F.col("y")) / pixel).cast("int")
    placed = blocks.withColumns({"row": row, "col": col}).where(F.col("row").between(0, shape[0] - 1) & F.col("col").between(0, shape[1] - 1))
    cx, cy = origin[0] + (F.col("col") + 0.5) * pixel, origin[1] - (F.col("row") + 0.5) * pixel
    away = (F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy)
    return placed.groupBy(*keys, "row", "col").agg(F.min_by(value, F.struct(F.round(away, digits), "x", "y", value)).alias(value))


def chips_of(pixels: DataFrame, tiles: DataFrame, pixel: float, size: int = 512, value: str = "value", fill: float = 0.0) -> DataFrame:
    """``chips`` of the tiles and bands that have any pixel; a band may be of any type."""
    side = (F.col("x1") - F.col("x0")) / size
    px = F.floor(F.col("x") / pixel).cast("long"), F.floor(F.col("y") / pixel).cast("long")
    known = pixels.groupBy("band", px[0].alias("_gx"), px[1].alias("_gy")).agg(F.max(value).cast("double").alias("_v"))
    places = tiles.select("tile_id", "x0", "y1", side.alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("_i"))
    x, y = F.col("x0") + (F.col("_i") % size + 0.5) * F.col("_s"), F.col("y1") - (F.floor(F.col("_i") / size) + 0.5) * F.col("_s")
    places = places.select("tile_id", "_i", F.floor(x / pixel).cast("long").alias("_gx"), F.floor(y / pixel).cast("long").alias("_gy"))
    found = places.join(known, ["_gx", "_gy"]).groupBy("tile_id", "band").agg(F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(fill)))
    return found.select("tile_id", "band", filled.alias("chip"))


def chips(pixels: DataFrame, tiles: DataFrame, pixel: float, size: int = 512, bands: Sequence[int] = (1,), value: str = "value", fill: float = 0.0) -> DataFrame:
    """A row for each tile and band with ``chip``, its size x size pixels row by row (north first):
    each place takes the pixel whose square holds its centre, ``fill`` where there is none (beyond
    the raster's edge). ``pixels``: band, x, y of centres and a value; ``tiles``: tile_id, x0, y0, x1,
    y1 of squares. Pixels and places meet by the pixel grid's indices, not by a range; of several
    pixels on one place the greatest counts."""
    every = tiles.select("tile_id", F.explode(F.array(*(F.lit(b) for b in bands))).alias("band"))
    return every.join(chips_of(pixels, tiles, pixel, size, value, fill), ["tile_id", "band"], "left").select("tile_id", "band", F.coalesce("chip", F.array_repeat(F.lit(fill), size * size)).alias("chip"))
