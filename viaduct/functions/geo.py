"""Geometry as column expressions: distances, projections, point tests. Angles in degrees, lengths in metres unless named km."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: GRS80 and the parameters of UTM zone 30 (fixed values).
A, FLAT, K0, LON0, EAST0 = 6378137.0, 1 / 298.257222101, 0.9996, -3.0, 500000.0
_N = FLAT / (2 - FLAT)
_R = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Krüger's series to the third order in the third flattening.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_E = (2 * _N**0.5) / (1 + _N)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def to_utm(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) in metres, zone 30 north."""
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.lit(_E) * F.atanh(F.lit(_E) * s))
    dl = F.radians(lon - F.lit(LON0))
    xi = F.atan2(t, F.cos(dl))
    eta = F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(EAST0) + F.lit(K0 * _R) * x, F.lit(K0 * _R) * y


def from_utm(x: Column, y: Column, lat: tuple = (35.0, 44.0), lon: tuple = (-10.0, 5.0)) -> tuple[Column, Column]:
    """(lat, lon) of zone 30 north; null outside the box."""
    xi, eta = y / F.lit(K0 * _R), (x - F.lit(EAST0)) / F.lit(K0 * _R)
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi1 = xi1 - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + F.lit(d) * F.sin(2 * j * chi)
    la, lo = F.degrees(phi), F.lit(LON0) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))
    inside = la.between(*lat) & lo.between(*lon)
    return F.when(inside, la), F.when(inside, lo)


def in_box(lat: Column, lon: Column, lats: tuple, lons: tuple) -> Column:
    """Ends included; null is outside."""
    return F.coalesce(lat.between(*lats) & lon.between(*lons), F.lit(False))


def foot(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """The point of the edge that is nearest to p; an edge of no length is its first end."""
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return x1 + t * dx, y1 + t * dy


def to_edge(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to an edge."""
    fx, fy = foot(px, py, x1, y1, x2, y2)
    return F.sqrt((px - fx) * (px - fx) + (py - fy) * (py - fy))


def crosses(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """1 if the edge crosses the ray from p to the east, else 0: an odd sum over a polygon's edges is inside."""
    at = x1 + F.try_divide((py - y1) * (x2 - x1), y2 - y1)
    return F.when(((y1 > py) != (y2 > py)) & (px < at), 1).otherwise(0)
