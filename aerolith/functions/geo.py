"""Geodesy on a sphere, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_NAUTICAL_MILE = 1.852


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; null if any coordinate is null. The root is clamped to 1, so antipodes give no NaN."""
    a1, o1, a2, o2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def on_globe(lat, lon) -> Column:
    """Both there, neither NaN, within the closed bounds. Never null."""
    lat, lon = _c(lat), _c(lon)
    ok = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    return F.coalesce(ok, F.lit(False))


def sphere_km(lat, lon) -> list[Column]:
    """x, y, z in km: differences have no seam at the date line and none at the poles."""
    a, o = F.radians(_c(lat)), F.radians(_c(lon))
    return [F.cos(a) * F.cos(o) * EARTH_KM, F.cos(a) * F.sin(o) * EARTH_KM, F.sin(a) * EARTH_KM]


def chord_km(p: list[Column], q: list[Column]) -> Column:
    return F.sqrt(sum(((a - b) * (a - b) for a, b in zip(p, q)), F.lit(0.0)))


def arc_of_chord(chord: Column) -> Column:
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), chord / (2 * EARTH_KM)))


def chord_of_arc(arc_km: float) -> float:
    import math

    return 2 * EARTH_KM * math.sin(min(arc_km / (2 * EARTH_KM), math.pi / 2))
