"""Map projections as Column expressions: transverse Mercator, UTM, Lambert conic, Albers, equidistant conic. Metres on the WGS 84 ellipsoid
(tmerc, utm) or the sphere with its major radius (conics)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geodesy import col

#: WGS 84.
A, INVERSE_F = 6378137.0, 298.257223563
FLAT = 1 / INVERSE_F
E2 = FLAT * (2 - FLAT)
#: Third flattening and the coefficients of the transverse Mercator series that follow from it.
N = FLAT / (2 - FLAT)
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)


def atanh(x: Column) -> Column:
    return F.log((1 + x) / (1 - x)) / 2


def tmerc(lat, lon, lon0, scale: float = 0.9996, east: float = 0.0, north=0.0) -> tuple[Column, Column]:
    """Easting and northing."""
    phi, dl = F.radians(col(lat)), F.radians(col(lon) - col(lon0))
    e = math.sqrt(E2)
    t = F.sinh(atanh(F.sin(phi)) - atanh(F.sin(phi) * e) * e)
    xi, eta = F.atan2(t, F.cos(dl)), atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a
        y = y + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a
    return x * (RECTIFYING * scale) + east, y * (RECTIFYING * scale) + north


def tmerc_inverse(x, y, lon0, scale: float = 0.9996, east: float = 0.0, north=0.0) -> tuple[Column, Column]:
    """Latitude and longitude."""
    xi, eta = (col(y) - north) / (RECTIFYING * scale), (col(x) - east) / (RECTIFYING * scale)
    a, b = xi, eta
    for j, c in enumerate(BETA, 1):
        a = a - F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * c
        b = b - F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * c
    chi = F.asin(F.sin(a) / F.cosh(b))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + F.sin(chi * (2 * j)) * d
    return F.degrees(phi), col(lon0) + F.degrees(F.atan2(F.sinh(b), F.cos(a)))


def utm_zone(lat, lon) -> Column:
    """Zone number, with the exceptions of southern Norway and Svalbard."""
    a, o = col(lat), col(lon)
    plain = F.pmod(F.floor((o + 180) / 6), F.lit(60)) + 1
    svalbard = F.when(o < 9, 31).when(o < 21, 33).when(o < 33, 35).otherwise(37)
    out = F.when((a >= 56) & (a < 64) & (o >= 3) & (o < 12), 32).when((a >= 72) & (a < 84) & (o >= 0) & (o < 42), svalbard)
    return out.otherwise(plain).cast("int")


def utm_letter(lat) -> Column:
    """Band letter C to X, without I and O; Z outside 80 south to 84 north."""
    at = F.least(F.floor((col(lat) + 80) / 8), F.lit(19)).cast("int") + 1
    return F.when(col(lat).between(-80, 84), F.substring(F.lit("CDEFGHJKLMNPQRSTUVWX"), at, F.lit(1))).otherwise("Z")


def utm(lat, lon) -> Column:
    """Struct zone, letter, east, north."""
    zone = utm_zone(lat, lon)
    x, y = tmerc(lat, lon, zone * 6 - 183, east=500000.0)
    return F.struct(zone.alias("zone"), utm_letter(lat).alias("letter"), x.alias("east"), (y + F.when(col(lat) < 0, 10000000.0).otherwise(0.0)).alias("north"))


def utm_inverse(east, north, zone, southern: bool = False) -> tuple[Column, Column]:
    return tmerc_inverse(east, north, col(zone) * 6 - 183, east=500000.0, north=10000000.0 if southern else 0.0)


def polar(rho: Column, theta: Column, rho0: float) -> tuple[Column, Column]:
    return rho * F.sin(theta) * A, (F.lit(rho0) - rho * F.cos(theta)) * A


def lcc(lat, lon, lat1: float, lat2: float, lat0: float = 0.0, lon0: float = 0.0) -> tuple[Column, Column]:
    """Lambert conformal conic."""
    p1, p2, p0 = (math.radians(v) for v in (lat1, lat2, lat0))
    half = lambda p: math.tan(math.pi / 4 + p / 2)
    n = math.sin(p1) if lat1 == lat2 else math.log(math.cos(p1) / math.cos(p2)) / math.log(half(p2) / half(p1))
    f = math.cos(p1) * half(p1) ** n / n
    rho = F.pow(F.tan(F.radians(col(lat)) / 2 + math.pi / 4), F.lit(-n)) * f
    return polar(rho, F.radians(col(lon) - lon0) * n, f / half(p0) ** n)


def aea(lat, lon, lat1: float, lat2: float, lat0: float = 0.0, lon0: float = 0.0) -> tuple[Column, Column]:
    """Albers equal area."""
    s1, s2, s0 = (math.sin(math.radians(v)) for v in (lat1, lat2, lat0))
    n = (s1 + s2) / 2
    c = 1 - s1 * s1 + 2 * n * s1
    rho = F.sqrt(F.lit(c) - F.sin(F.radians(col(lat))) * (2 * n)) / n
    return polar(rho, F.radians(col(lon) - lon0) * n, math.sqrt(c - 2 * n * s0) / n)


def eqdc(lat, lon, lat1: float, lat2: float, lat0: float = 0.0, lon0: float = 0.0) -> tuple[Column, Column]:
    """Equidistant conic."""
    p1, p2, p0 = (math.radians(v) for v in (lat1, lat2, lat0))
    n = math.sin(p1) if lat1 == lat2 else (math.cos(p1) - math.cos(p2)) / (p2 - p1)
    g = math.cos(p1) / n + p1
    return polar(F.lit(g) - F.radians(col(lat)), F.radians(col(lon) - lon0) * n, g - p0)
