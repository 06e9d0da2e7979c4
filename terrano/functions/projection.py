"""Map projections as column expressions on the GRS80 ellipsoid: degrees to metres and back.

LAEA is the European equal-area grid (EPSG:3035), TM the national transverse Mercator grid
(EPSG:2180).  Series are cut where they are below a tenth of a millimetre.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: GRS80, and the parameters of both grids.
A, INVERSE_FLATTENING = 6378137.0, 298.257222101
LAEA = {"lat": 52.0, "lon": 10.0, "x": 4321000.0, "y": 3210000.0}
TM = {"lon": 19.0, "scale": 0.9993, "x": 500000.0, "y": -5300000.0}

_f = 1 / INVERSE_FLATTENING
_e2 = _f * (2 - _f)
_e = math.sqrt(_e2)


def _authalic(s):
    """Snyder's q at the sine of a latitude, for numbers and columns."""
    log = math.log if isinstance(s, float) else F.log
    return (1 - _e2) * (s / (1 - _e2 * s * s) - log((1 - _e * s) / (1 + _e * s)) / (2 * _e))


_qp = _authalic(1.0)
_rq = A * math.sqrt(_qp / 2)
_s1 = math.sin(math.radians(LAEA["lat"]))
_b1 = math.asin(_authalic(_s1) / _qp)
_d = A * math.cos(math.radians(LAEA["lat"])) / math.sqrt(1 - _e2 * _s1 * _s1) / (_rq * math.cos(_b1))


def to_laea(lon: Column, lat: Column) -> tuple[Column, Column]:
    """x, y in metres."""
    dl = F.radians(lon - LAEA["lon"])
    b = F.asin(F.least(F.greatest(_authalic(F.sin(F.radians(lat))) / _qp, F.lit(-1.0)), F.lit(1.0)))
    k = _rq * F.sqrt(2 / (1 + math.sin(_b1) * F.sin(b) + math.cos(_b1) * F.cos(b) * F.cos(dl)))
    return LAEA["x"] + k * _d * F.cos(b) * F.sin(dl), LAEA["y"] + k / _d * (math.cos(_b1) * F.sin(b) - math.sin(_b1) * F.cos(b) * F.cos(dl))


def from_laea(x: Column, y: Column) -> tuple[Column, Column]:
    """lon, lat in degrees."""
    u, v = (x - LAEA["x"]) / _d, (y - LAEA["y"]) * _d
    rho = F.sqrt(u * u + v * v)
    c = 2 * F.asin(rho / (2 * _rq))
    share = F.when(rho == 0, 0.0).otherwise(v * F.sin(c) / rho)
    b = F.asin(F.cos(c) * math.sin(_b1) + share * math.cos(_b1))
    e4, e6 = _e2**2, _e2**3
    lat = b + (_e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * b) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * b) + 761 * e6 / 45360 * F.sin(6 * b)
    lon = F.atan2(u * F.sin(c), rho * math.cos(_b1) * F.cos(c) - v * math.sin(_b1) * F.sin(c))
    return F.degrees(lon) + LAEA["lon"], F.degrees(lat)


_n = _f / (2 - _f)
_radius = A / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
_forward = [_n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16, 13 * _n**2 / 48 - 3 * _n**3 / 5, 61 * _n**3 / 240]
_back = [_n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96, _n**2 / 48 + _n**3 / 15, 17 * _n**3 / 480]
_to_lat = [2 * _n - 2 * _n**2 / 3 - 2 * _n**3, 7 * _n**2 / 3 - 8 * _n**3 / 5, 56 * _n**3 / 15]


def to_tm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting, northing in metres (Krueger's series)."""
    s, dl = F.sin(F.radians(lat)), F.radians(lon - TM["lon"])
    t = F.sinh(F.atanh(s) - _e * F.atanh(_e * s))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, a in enumerate(_forward, 1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return TM["x"] + TM["scale"] * _radius * east, TM["y"] + TM["scale"] * _radius * north


def from_tm(x: Column, y: Column) -> tuple[Column, Column]:
    """lon, lat in degrees."""
    xi0, eta0 = (y - TM["y"]) / (TM["scale"] * _radius), (x - TM["x"]) / (TM["scale"] * _radius)
    xi, eta = xi0, eta0
    for j, b in enumerate(_back, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(_to_lat, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + TM["lon"], F.degrees(lat)
