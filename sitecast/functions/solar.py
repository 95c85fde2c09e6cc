"""Position of the sun from the Fourier series of Spencer (1971), as column expressions.

Good to about a quarter of a degree. Timestamps are UTC, angles in degrees.
"""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitecast.functions.clock import minute_of_day

# Published coefficients (constant, cos, sin, cos 2x, sin 2x, cos 3x, sin 3x).
DECLINATION = [0.006918, -0.399912, 0.070257, -0.006758, 0.000907, -0.002697, 0.00148]
EQUATION_OF_TIME = [0.000075, 0.001868, -0.032077, -0.014615, -0.040849]
MINUTES_PER_RADIAN = 229.18


def _series(angle: Column, coefficients: list[float]) -> Column:
    total = F.lit(coefficients[0])
    for i, c in enumerate(coefficients[1:]):
        turn = angle * (i // 2 + 1)
        total = total + F.lit(c) * (F.cos(turn) if i % 2 == 0 else F.sin(turn))
    return total


def sun_angles(ts: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """(zenith, azimuth clockwise from north) in degrees."""
    minutes = minute_of_day(ts)
    angle = (F.dayofyear(ts) - 1 + (minutes / 60 - 12) / 24) * (2 * math.pi / 365)
    decl = _series(angle, DECLINATION)
    solar_minutes = minutes + _series(angle, EQUATION_OF_TIME) * MINUTES_PER_RADIAN + lon * 4
    hour_angle = F.radians(solar_minutes / 4 - 180)
    phi = F.radians(lat)
    cos_zenith = F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.cos(hour_angle)
    zenith = F.degrees(F.acos(F.greatest(F.least(cos_zenith, F.lit(1.0)), F.lit(-1.0))))
    azimuth = F.degrees(
        F.atan2(
            F.sin(hour_angle),
            F.cos(hour_angle) * F.sin(phi) - F.tan(decl) * F.cos(phi),
        )
    ) + 180
    return zenith, azimuth
