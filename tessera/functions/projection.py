"""Map projections as Spark expressions: transverse Mercator (UTM) by Krueger's series to the
fourth order (well below a millimetre within a zone), and the conterminous US Albers projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS 84 ellipsoid, and the parameters of the two projections.
A, FLAT = 6378137.0, 1 / 298.257223563
SCALE, EASTING, SOUTH_NORTHING = 0.9996, 500_000.0, 10_000_000.0
ALBERS_PARALLELS, ALBERS_ORIGIN = (29.5, 45.5), (-96.0, 23.0)

_N = FLAT / (2 - FLAT)
_E2 = FLAT * (2 - FLAT)
_E = math.sqrt(_E2)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def _sum(first: Column, terms) -> Column:
    for t in terms:
        first = first + t
    return first


def to_utm(lon: Column, lat: Column, zone: int, south: bool = False) -> Column:
    """struct<x, y> in metres of degrees on WGS 84."""
    turn, phi = F.radians(lon - (6 * zone - 183)), F.radians(lat)
    sine = F.sin(phi)
    t = F.sinh(F.atanh(sine) - _E * F.atanh(_E * sine))
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    x = _sum(eta, (a * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, a in enumerate(_ALPHA, 1)))
    y = _sum(xi, (a * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, a in enumerate(_ALPHA, 1)))
    return F.struct((EASTING + SCALE * _RADIUS * x).alias("x"), ((SOUTH_NORTHING if south else 0.0) + SCALE * _RADIUS * y).alias("y"))


def from_utm(x: Column, y: Column, zone: int, south: bool = False) -> Column:
    """struct<lon, lat> in degrees."""
    xi, eta = (y - (SOUTH_NORTHING if south else 0.0)) / (SCALE * _RADIUS), (x - EASTING) / (SCALE * _RADIUS)
    xi0 = _sum(xi, (-b * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, b in enumerate(_BETA, 1)))
    eta0 = _sum(eta, (-b * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, b in enumerate(_BETA, 1)))
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    lat = _sum(chi, (d * F.sin(2 * k * chi) for k, d in enumerate(_DELTA, 1)))
    return F.struct((6 * zone - 183 + F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0)))).alias("lon"), F.degrees(lat).alias("lat"))


def _q(sine: float) -> float:
    return (1 - _E2) * (sine / (1 - _E2 * sine**2) - math.log((1 - _E * sine) / (1 + _E * sine)) / (2 * _E))


def to_albers(lon: Column, lat: Column) -> Column:
    """struct<x, y> in metres, equal in area."""
    m = [math.cos(math.radians(p)) / math.sqrt(1 - _E2 * math.sin(math.radians(p)) ** 2) for p in ALBERS_PARALLELS]
    q = [_q(math.sin(math.radians(p))) for p in ALBERS_PARALLELS]
    n = (m[0] ** 2 - m[1] ** 2) / (q[1] - q[0])
    c = m[0] ** 2 + n * q[0]
    rho0 = A * math.sqrt(c - n * _q(math.sin(math.radians(ALBERS_ORIGIN[1])))) / n
    sine = F.sin(F.radians(lat))
    here = (1 - _E2) * (sine / (1 - _E2 * sine * sine) - F.log((1 - _E * sine) / (1 + _E * sine)) / (2 * _E))
    rho, theta = A * F.sqrt(c - n * here) / n, n * F.radians(lon - ALBERS_ORIGIN[0])
    return F.struct((rho * F.sin(theta)).alias("x"), (rho0 - rho * F.cos(theta)).alias("y"))
