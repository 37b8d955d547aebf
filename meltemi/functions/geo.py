"""Great-circle geometry in nautical miles and degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_NM = 3440.065


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def distance_nm(lat1, lon1, lat2, lon2) -> Column:
    """Haversine distance; the arcsine argument is clamped so rounding cannot push it past 1."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat, dlon = p2 - p1, F.radians(_c(lon2)) - F.radians(_c(lon1))
    h = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS_NM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial compass bearing from the first point to the second, 0 to 360."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlon = F.radians(_c(lon2)) - F.radians(_c(lon1))
    y = F.sin(dlon) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def lat_reach_deg(radius_nm: float) -> float:
    """Half-height in degrees of the box around a circle of ``radius_nm``."""
    import math

    return min(180.0, math.degrees(radius_nm / EARTH_RADIUS_NM))


def lon_reach_deg(lat, radius_nm: float) -> Column:
    """Half-width in degrees of the box around a circle centred at ``lat``; the whole turn near a pole."""
    import math

    angle = radius_nm / EARTH_RADIUS_NM
    if angle >= math.pi / 2:
        return F.lit(360.0)
    ratio = F.lit(math.sin(angle)) / F.cos(F.radians(_c(lat)))
    over_pole = (F.abs(_c(lat)) + math.degrees(angle)) >= 90.0
    return F.when(over_pole, F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), ratio))))
