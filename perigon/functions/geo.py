"""Distance, speed and spacing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6371009.0


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points in degrees, exactly 0 for equal points."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    across = F.sqrt(F.pow(F.cos(q) * F.sin(d), 2) + F.pow(F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d), 2))
    along = F.sin(p) * F.sin(q) + F.cos(p) * F.cos(q) * F.cos(d)
    metres = F.lit(EARTH_METRES) * F.atan2(across, along)
    return F.when((lat1 == lat2) & (lon1 == lon2), F.lit(0.0)).otherwise(metres)


def speed_kmh(metres: Column, seconds: Column) -> Column:
    """Apparent speed; -1 where no time has passed."""
    return F.when(seconds > 0, metres * 3.6 / seconds).otherwise(F.lit(-1.0))


def log_spacing(metres: Column) -> Column:
    return F.log2(metres + 1)


def plausibility(speed: Column, seconds: Column) -> Column:
    """Class of a placed observation that is not the first of its day."""
    return (
        F.when(speed > 200, "kmh_over_200").when(speed > 80, "kmh_80_200").when(speed > 25, "kmh_25_80").when(speed > 10, "kmh_10_25")
        .when(speed > 5, "kmh_5_10").when(speed > 0, "kmh_0_5").when(seconds == 0, "instantaneous").otherwise("stationary")
    )
