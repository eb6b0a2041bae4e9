"""Distances, map projection and grid indices as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
METRES_PER_DEGREE = 111320.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    a = F.pow(half(lat1, lat2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(half(lon1, lon2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(a))


def east_offset_degrees(metres: float, lat: Column) -> Column:
    """Degrees of longitude that many metres east at this latitude."""
    return F.lit(metres) / (F.lit(METRES_PER_DEGREE) * F.cos(F.radians(lat)))


def length(dx: Column, dy: Column) -> Column:
    return F.hypot(dx, dy)


def utm_south(lon: Column, lat: Column, zone: int = 48) -> tuple[Column, Column]:
    """Easting and northing (southern hemisphere) on WGS84.

    Transverse Mercator by the third-order Krueger series in the third
    flattening n, the form published for the national grids.
    """
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    lon0 = math.radians(zone * 6 - 183)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon) - F.lit(lon0)
    atanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    t = F.sinh(atanh(F.sin(phi)) - F.lit(e) * atanh(F.lit(e) * F.sin(phi)))
    xi = F.atan2(t, F.cos(lam))
    eta = atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, aj in enumerate(alpha, start=1):
        east = east + F.lit(aj) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(aj) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(500000.0) + F.lit(0.9996 * big_a) * east, F.lit(10000000.0) + F.lit(0.9996 * big_a) * north


def grid_row(lat: Column, top: float = 59.95, step: float = 0.1) -> Column:
    """Row of a north-up grid, halves to even as in IEEE rounding."""
    return F.rint((F.lit(top) - lat) / F.lit(step)).cast("int")


def grid_col(lon: Column, left: float = 0.05, step: float = 0.1) -> Column:
    return F.rint((lon - F.lit(left)) / F.lit(step)).cast("int")


def row_centre(row: Column, top: float = 59.95, step: float = 0.1) -> Column:
    return F.lit(top) - row * F.lit(step)


def col_centre(col: Column, left: float = 0.05, step: float = 0.1) -> Column:
    return F.lit(left) + col * F.lit(step)


def power_to_db(power: Column) -> Column:
    return F.when(power > 0, 10 * F.log10(power))


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring ``array<struct<x,y>>`` (closed or not)."""
    n = F.size(ring)
    edges = F.transform(
        ring, lambda p, i: F.struct(p.alias("a"), F.element_at(ring, ((i + 1) % n + 1).cast("int")).alias("b"))
    )

    def crosses(e):
        ay, by = e["a"]["y"], e["b"]["y"]
        at = (e["b"]["x"] - e["a"]["x"]) * (y - ay) / F.nullif(by - ay, F.lit(0.0)) + e["a"]["x"]
        return F.coalesce(((ay > y) != (by > y)) & (x < at), F.lit(False))

    return F.size(F.filter(edges, crosses)) % 2 == 1
