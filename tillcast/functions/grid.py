"""latitude/longitude to the 5 km Lambert-conformal weather grid (nx, ny).

Written with native column math; every projection constant folds at plan time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The national forecast grid's projection parameters.
EARTH_RADIUS_KM = 6371.00877
GRID_KM = 5.0
STANDARD_LAT_1 = 30.0
STANDARD_LAT_2 = 60.0
ORIGIN_LON = 126.0
ORIGIN_LAT = 38.0
ORIGIN_X = 43
ORIGIN_Y = 136
# Fixed value: cell used when no coordinates are given (the capital's cell).
DEFAULT_CELL = (61, 125)


def _projection_constants():
    rad = math.pi / 180.0
    re = EARTH_RADIUS_KM / GRID_KM
    s1, s2 = STANDARD_LAT_1 * rad, STANDARD_LAT_2 * rad
    olat = ORIGIN_LAT * rad
    sn = math.log(math.cos(s1) / math.cos(s2)) / math.log(
        math.tan(math.pi * 0.25 + s2 * 0.5) / math.tan(math.pi * 0.25 + s1 * 0.5))
    sf = math.pow(math.tan(math.pi * 0.25 + s1 * 0.5), sn) * math.cos(s1) / sn
    ro = re * sf / math.pow(math.tan(math.pi * 0.25 + olat * 0.5), sn)
    return rad, re, sn, sf, ro


def grid_cell(lat, lon) -> tuple[Column, Column]:
    """Return (nx, ny) integer columns for latitude / longitude columns."""
    lat = F.col(lat) if isinstance(lat, str) else lat
    lon = F.col(lon) if isinstance(lon, str) else lon
    rad, re, sn, sf, ro = _projection_constants()
    ra = F.lit(re * sf) / F.pow(F.tan(F.lit(math.pi * 0.25) + lat * (rad * 0.5)), F.lit(sn))
    theta0 = lon * rad - ORIGIN_LON * rad
    theta1 = F.when(theta0 > math.pi, theta0 - 2.0 * math.pi).otherwise(theta0)
    theta = F.when(theta1 < -math.pi, theta1 + 2.0 * math.pi).otherwise(theta1) * sn
    nx = F.floor(ra * F.sin(theta) + ORIGIN_X + 0.5).cast("int")
    ny = F.floor(F.lit(ro) - ra * F.cos(theta) + ORIGIN_Y + 0.5).cast("int")
    return nx, ny
