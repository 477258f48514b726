"""UTM zone 32N (WGS84) to latitude and longitude as column arithmetic.

Inverse transverse Mercator by the published Krueger series in the third
flattening n, third order; the whole table is converted inside codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid and UTM zone 32 constants.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500000.0
CENTRAL_MERIDIAN = 9.0

_N = FLATTENING / (2 - FLATTENING)
RECTIFYING_RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
BETA = [
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96,
    _N**2 / 48 + _N**3 / 15,
    17 * _N**3 / 480,
]
DELTA = [
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3,
    7 * _N**2 / 3 - 8 * _N**3 / 5,
    56 * _N**3 / 15,
]

# The range German coordinates in degrees fall into.
LATITUDE_RANGE = (47, 55)
LONGITUDE_RANGE = (5, 16)


def utm32_to_wgs84(easting: Column, northing: Column) -> tuple[Column, Column]:
    """(latitude, longitude) in degrees."""
    xi = northing / F.lit(SCALE * RECTIFYING_RADIUS)
    eta = (easting - F.lit(FALSE_EASTING)) / F.lit(SCALE * RECTIFYING_RADIUS)
    xi_c, eta_c = xi, eta
    for j, beta in enumerate(BETA, start=1):
        xi_c = xi_c - F.lit(beta) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
        eta_c = eta_c - F.lit(beta) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
    chi = F.asin(F.sin(xi_c) / F.cosh(eta_c))
    latitude = chi
    for j, delta in enumerate(DELTA, start=1):
        latitude = latitude + F.lit(delta) * F.sin(chi * (2 * j))
    longitude = F.lit(math.radians(CENTRAL_MERIDIAN)) + F.atan2(F.sinh(eta_c), F.cos(xi_c))
    return F.degrees(latitude), F.degrees(longitude)


def looks_like_degrees(x: Column, y: Column) -> Column:
    """Aggregate: some x lies in the longitude range and some y in the latitude range."""
    return F.bool_or(y.between(*LATITUDE_RANGE)) & F.bool_or(x.between(*LONGITUDE_RANGE))
