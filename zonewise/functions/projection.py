"""Transverse Mercator for the Israel 1993 grid as plain Column arithmetic.

The series are Krueger's (1912) to fourth order in the third flattening; they stay inside whole-stage code generation.
The tens-of-metres datum shift against WGS84 is left out: it moves all positions alike and changes distances by parts
per million.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public EPSG:2039 definition on the GRS80 ellipsoid.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
LAT_ORIGIN = 31.7343936111111
LON_ORIGIN = 35.2045169444444
SCALE = 1.0000067
FALSE_EASTING = 219529.584
FALSE_NORTHING = 626907.39

_n = FLATTENING / (2 - FLATTENING)
_ecc = 2 * math.sqrt(_n) / (1 + _n)
RADIUS = SCALE * SEMI_MAJOR / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
ECCENTRICITY = _ecc
# Published series coefficients.
ALPHA = (
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180,
    13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440,
    61 * _n**3 / 240 - 103 * _n**4 / 140,
    49561 * _n**4 / 161280,
)
BETA = (
    _n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360,
    _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440,
    17 * _n**3 / 480 - 37 * _n**4 / 840,
    4397 * _n**4 / 161280,
)
DELTA = (
    2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45,
    7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45,
    56 * _n**3 / 15 - 136 * _n**4 / 35,
    4279 * _n**4 / 630,
)


def _origin_xi() -> float:
    s = math.sin(math.radians(LAT_ORIGIN))
    chi = math.atan(math.sinh(math.atanh(s) - _ecc * math.atanh(_ecc * s)))
    return chi + sum(a * math.sin(2 * (j + 1) * chi) for j, a in enumerate(ALPHA))


ORIGIN_XI = _origin_xi()


def _sphere(lon: Column, lat: Column) -> tuple[Column, Column]:
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.lit(_ecc) * F.atanh(F.lit(_ecc) * s))
    dl = F.radians(lon - F.lit(LON_ORIGIN))
    return F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(F.lit(1.0) + t * t))


def _series(xi: Column, eta: Column, coefficients, sign: float) -> tuple[Column, Column]:
    u, v = xi, eta
    for j, c in enumerate(coefficients):
        k = F.lit(2.0 * (j + 1))
        u = u + F.lit(sign * c) * F.sin(k * xi) * F.cosh(k * eta)
        v = v + F.lit(sign * c) * F.cos(k * xi) * F.sinh(k * eta)
    return u, v


def _to_grid(xi: Column, eta: Column) -> tuple[Column, Column]:
    u, v = _series(xi, eta, ALPHA, 1.0)
    x = F.lit(FALSE_EASTING) + F.lit(RADIUS) * v
    y = F.lit(FALSE_NORTHING) + F.lit(RADIUS) * (u - F.lit(ORIGIN_XI))
    return x, y


def project(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to metres (easting, northing)."""
    return _to_grid(*_sphere(lon, lat))


def unproject(x: Column, y: Column) -> tuple[Column, Column]:
    """Metres to degrees (lon, lat)."""
    xi = (y - F.lit(FALSE_NORTHING)) / F.lit(RADIUS) + F.lit(ORIGIN_XI)
    eta = (x - F.lit(FALSE_EASTING)) / F.lit(RADIUS)
    u, v = _series(xi, eta, BETA, -1.0)
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for j, d in enumerate(DELTA):
        phi = phi + F.lit(d) * F.sin(F.lit(2.0 * (j + 1)) * chi)
    lon = F.lit(LON_ORIGIN) + F.degrees(F.atan2(F.sinh(v), F.cos(u)))
    return lon, F.degrees(phi)


def project_vertices(ring: Column) -> Column:
    """Project every ``struct<x,y>`` of an array. Two passes, since lambda bodies share no common subexpressions."""

    def first(v):
        xi, eta = _sphere(v["x"], v["y"])
        return F.struct(xi.alias("x"), eta.alias("y"))

    def second(v):
        x, y = _to_grid(v["x"], v["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(F.transform(ring, first), second)


def unproject_vertices(ring: Column) -> Column:
    def back(v):
        lon, lat = unproject(v["x"], v["y"])
        return F.struct(lon.alias("x"), lat.alias("y"))

    return F.transform(ring, back)
