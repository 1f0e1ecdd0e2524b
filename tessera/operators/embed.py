"""Embedding of chips by a frozen encoder, in Arrow batches.

The pre-trained encoder is not part of this repository. ``RandomProjection`` stands in for it: a
fixed projection of band statistics, deterministic, good for tests and plumbing and nothing else.
Any callable of the same form can take its place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import latlon_vector, time_vector
from ..functions.vectors import mean_vector
from .raster import chips_of


class PatchMeans:
    """An encoder that can be followed by hand: a token a patch, the patch's mean of each band; the
    chip's pixels come band by band, row by row."""

    def __init__(self, bands: int, patch: int) -> None:
        self.bands, self.patch = bands, patch

    def __call__(self, pixels: np.ndarray, meta: np.ndarray) -> np.ndarray:
        side = int(round((pixels.shape[1] / self.bands) ** 0.5))
        n, p = side // self.patch, self.patch
        x = pixels.reshape(len(pixels), self.bands, n, p, n, p).mean(axis=(3, 5))
        return x.reshape(len(pixels), self.bands, n * n).transpose(0, 2, 1)


class RandomProjection:
    """Stand-in encoder: pixels (n, k) and metadata (n, m) to vectors (n, dim). Its state is its
    dimension and seed; ``weights`` and ``of`` keep it as a table, as a checkpoint would be."""

    def weights(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([("dim", float(self.dim)), ("seed", float(self.seed))], "name string, value double")

    @classmethod
    def of(cls, weights: DataFrame) -> RandomProjection:
        rows = {r["name"]: int(r["value"]) for r in weights.limit(3).collect()}
        return cls(rows["dim"], rows["seed"])

    def __init__(self, dim: int = 1024, seed: int = 0) -> None:
        self.dim, self.seed = dim, seed

    def __call__(self, pixels: np.ndarray, meta: np.ndarray) -> np.ndarray:
        x = np.concatenate([pixels, meta], axis=1)
        w = np.random.default_rng(self.seed).normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], self.dim))
        return np.tanh(x @ w).astype(np.float32)


def embed(chips: DataFrame, encoder: Callable[[np.ndarray, np.ndarray], np.ndarray], pixels: str = "pixels", meta: str = "meta", batch: int = 32) -> DataFrame:
    """Adds ``embedding`` to rows of normalised pixel arrays (of one length) and metadata arrays.
    The encoder is sent to each task once and sees ``batch`` rows at a time; it gives a vector each
    (n, dim), or tokens (n, tokens, dim), whose mean is taken. Rows of chips go to it as they come, so
    an empty table gives an empty one."""
    kept = [f for f in chips.schema if f.name not in (pixels, meta)]
    names = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", embedding array<float>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), batch):
                x = part.iloc[lo : lo + batch]
                made = encoder(np.stack(x[pixels].to_numpy()).astype(float), np.stack(x[meta].to_numpy()).astype(float))
                made = made.mean(axis=1) if made.ndim == 3 else made
                yield x[names].assign(embedding=list(np.asarray(made, np.float32)))

    return chips.mapInPandas(run, schema)


def pool_quadrants(embedded: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """The mean of a chip's quadrants."""
    return mean_vector(embedded, keys, vector).select(*keys, F.col("mean_vector").cast("array<float>").alias("embedding"))


def embed_composites(pixels: DataFrame, tiles: DataFrame, bands: DataFrame, encoder: Callable[[np.ndarray, np.ndarray], np.ndarray], *, pixel: float, size: int = 512, batch: int = 32) -> DataFrame:
    """From composites to a vector for each tile and composite: (composite, tile_id, embedding).

    ``pixels``: (composite, day, band, x, y, value) of all composites; ``tiles``: tile_id, x0, y0, x1,
    y1, lat, lon; ``bands``: (band, mean, std). A tile's chip is cut, padded and resampled to ``size``,
    normalised by band, split into four quadrants; each goes through the encoder with the vectors of
    its day and place, and the tile's vector is the mean of its quadrants'. Beyond the composite pixels
    are 0 before they are normalised, as nodata is.
    """
    order = [r["band"] for r in bands.select("band").distinct().orderBy("band").limit(1000).collect()]
    half, n = size // 2, size * size
    days = pixels.groupBy("composite").agg(F.min("day").alias("day"))
    cells = tiles.join(F.broadcast(days) if days.count() <= 10_000 else days).select(F.struct("composite", "tile_id").alias("tile_id"), "x0", "y0", "x1", "y1", "lat", "lon", "day")
    # A chip belongs to a tile of a composite: the band's name carries the composite through the cut.
    both = pixels.select(F.struct("composite", "band").alias("band"), "x", "y", "value")
    cut = chips_of(both, tiles, pixel, size).where("band is not null")
    long = cut.select(F.col("band.composite").alias("composite"), "tile_id", F.col("band.band").alias("band"), "chip")
    every = cells.select("tile_id.composite", "tile_id.tile_id", "lat", "lon", "day").join(F.broadcast(bands))
    filled = every.join(long, ["composite", "tile_id", "band"], "left").withColumn("chip", F.coalesce("chip", F.array_repeat(F.lit(0.0), n)))
    scaled = filled.withColumn("chip", F.transform("chip", lambda v: (v - F.col("mean")) / F.col("std")))
    quarter = lambda r, c: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: F.slice("chip", (i + r * half) * size + c * half + 1, half)))
    parts = F.array(*(F.struct(F.lit(2 * r + c).alias("quadrant"), quarter(r, c).alias("pixels")) for r in (0, 1) for c in (0, 1)))
    split = scaled.select("composite", "tile_id", "lat", "lon", "day", "band", F.explode(parts).alias("q")).select("composite", "tile_id", "lat", "lon", "day", "band", "q.*")
    stacked = split.groupBy("composite", "tile_id", "lat", "lon", "day", "quadrant").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("band", "pixels"))), lambda s: s["pixels"])).alias("pixels"))
    meta = F.concat(time_vector(F.col("day")), latlon_vector(F.col("lat"), F.col("lon")))
    if not order:
        raise ValueError("no bands")
    made = embed(stacked.select("composite", "tile_id", "quadrant", "pixels", meta.alias("meta")), encoder, batch=batch)
    return pool_quadrants(made, ["composite", "tile_id"])
