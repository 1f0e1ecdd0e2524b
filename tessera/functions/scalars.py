"""Scalar expressions. All stay in generated code; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DN_SCALE = 10_000.0
EPSILON = 1e-6


def reflectance(dn: Column) -> Column:
    return dn / DN_SCALE


def valid_pixel(*dn: Column) -> Column:
    """Every band is above 0 and at most 10000; an unknown value is not valid."""
    ok = F.lit(True)
    for b in dn:
        ok = ok & (b > 0) & (b <= DN_SCALE)
    return F.coalesce(ok, F.lit(False))


def ndvi(red: Column, nir: Column) -> Column:
    return (nir - red) / F.greatest(nir + red, F.lit(EPSILON))


def evi(blue: Column, red: Column, nir: Column) -> Column:
    raw = 2.5 * (nir - red) / F.greatest(nir + 6.0 * red - 7.5 * blue + 1.0, F.lit(EPSILON))
    return clamp(raw, -1.0, 1.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def null_if_nan(x: Column) -> Column:
    """NaN is above everything in Spark; unknown values are null throughout."""
    return F.when(~F.isnan(x), x)


def z_score(x: Column, mean: Column, sd: Column) -> Column:
    """Null where the history is constant or too short."""
    return (x - mean) / F.nullif(sd, F.lit(0.0))


def stress_label(x: Column, z: Column, threshold: float = -1.5) -> Column:
    """-1 unknown, 1 stressed, 0 not."""
    return F.when(x.isNull() | z.isNull(), -1).when(z < threshold, 1).otherwise(0)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def snap_down(x: Column, size: float) -> Column:
    """The grid line at or below x."""
    return F.floor(x / size) * size


def pixel_offset(x: Column, origin: Column | float, size: float) -> Column:
    """Nearest whole pixel, halves to even."""
    return F.bround((x - origin) / size).cast("int")


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def quadrant(row: Column, col: Column, half: int = 256) -> Column:
    """0 to 3: top left, top right, bottom left, bottom right."""
    return (F.floor(row / half) * 2 + F.floor(col / half)).cast("int")


def time_vector(day: Column) -> Column:
    """Sine and cosine of the ISO week's and of midday's angle."""
    week = F.weekofyear(day) * (2 * 3.141592653589793 / 52)
    return F.array(F.sin(week), F.cos(week), F.lit(1.2246467991473532e-16), F.lit(-1.0))


def latlon_vector(lat: Column, lon: Column) -> Column:
    return F.array(F.sin(F.radians(lat)), F.cos(F.radians(lat)), F.sin(F.radians(lon)), F.cos(F.radians(lon)))


def f1(precision: Column, recall: Column) -> Column:
    return 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))
