"""Expected output of wind and solar assets, as column expressions over measured channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Panel derating, solar declination, air mass and beam transmission.
DERATE_PER_DEG, DERATE_FROM_C, DERATE_FLOOR = 0.004, 25.0, 0.70
AXIAL_TILT_DEG, EQUINOX_DAY, YEAR_DAYS = 23.45, 81, 365.0
AIR_MASS_SCALE, AIR_MASS_SHIFT_DEG, AIR_MASS_POWER = 0.50572, 6.07995, -1.6364
SOLAR_CONSTANT_WM2, TRANSMITTANCE, TRANSMIT_POWER = 1361.0, 0.7, 0.678
LOWEST_SUN = 0.02


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def expected_wind_mw(speed, cut_in, rated, cut_out, capacity) -> Column:
    """Power curve: nothing outside the operating range, cubic up to rated speed, flat above it."""
    v, lo, mid, hi, cap = map(_c, (speed, cut_in, rated, cut_out, capacity))
    ramp = (v - lo) / (mid - lo)
    return (
        F.when((v < lo) | (v > hi), F.lit(0.0))
        .when(v >= mid, cap)
        .otherwise(cap * ramp * ramp * ramp)
    )


def solar_derate(panel_temp) -> Column:
    """Share of power left after heat loss; never below its floor."""
    excess = F.greatest(F.lit(0.0), _c(panel_temp) - F.lit(DERATE_FROM_C))
    return F.greatest(F.lit(DERATE_FLOOR), F.lit(1.0) - F.lit(DERATE_PER_DEG) * excess)


def expected_solar_kw(capacity_kw, irradiance, panel_temp) -> Column:
    return _c(capacity_kw) * (_c(irradiance) / F.lit(1000.0)) * solar_derate(panel_temp)


def _sun_height(lat, day_of_year, hour_local, noon: float) -> Column:
    """Sine of the sun's elevation at a latitude, day and local hour."""
    season = F.sin(F.radians((_c(day_of_year) - F.lit(EQUINOX_DAY)) * F.lit(360.0 / YEAR_DAYS)))
    tilt = F.radians(season * F.lit(AXIAL_TILT_DEG))
    turn = F.radians((_c(hour_local) - F.lit(noon)) * F.lit(15.0))
    phi = F.radians(_c(lat))
    return F.sin(phi) * F.sin(tilt) + F.cos(phi) * F.cos(tilt) * F.cos(turn)


def clear_sky_wm2(lat, day_of_year, hour_local, noon: float = 12.5) -> Column:
    """Cloudless irradiance from solar elevation and relative air mass; 0 when the sun is down."""
    height = _sun_height(lat, day_of_year, hour_local, noon)
    # The bounds keep the fractional powers defined where the result is not used.
    up = F.least(F.greatest(height, F.lit(LOWEST_SUN)), F.lit(1.0))
    lift = F.pow(F.degrees(F.asin(up)) + F.lit(AIR_MASS_SHIFT_DEG), F.lit(AIR_MASS_POWER))
    mass = F.lit(1.0) / (up + F.lit(AIR_MASS_SCALE) * lift)
    passed = F.pow(F.lit(TRANSMITTANCE), F.pow(mass, F.lit(TRANSMIT_POWER)))
    return F.when(height <= LOWEST_SUN, F.lit(0.0)).otherwise(F.lit(SOLAR_CONSTANT_WM2) * passed * up)
