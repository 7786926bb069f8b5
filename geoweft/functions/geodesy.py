"""Distances, bearings and boxes on the sphere as Column expressions (degrees in, latitude first)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
EARTH_M = 6371000.0


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def central_angle(lat1, lon1, lat2, lon2) -> Column:
    """Angle between two points by the haversine formula in its atan2 form."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    dlat, dlon = F.radians(col(lat2) - col(lat1)), F.radians(col(lon2) - col(lon1))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(dlon / 2), 2)
    return F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h))) * 2


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    return central_angle(lat1, lon1, lat2, lon2) * EARTH_KM


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    return central_angle(lat1, lon1, lat2, lon2) * EARTH_M


def heading(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in [0, 360)."""
    a, b, d = F.radians(col(lat1)), F.radians(col(lat2)), F.radians(col(lon2) - col(lon1))
    turn = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(turn + 360.0, F.lit(360.0))


def destination(lat, lon, bearing, km) -> tuple[Column, Column]:
    """Latitude and longitude after so many km in a direction; the longitude is not wrapped."""
    a, o, b, d = F.radians(col(lat)), F.radians(col(lon)), F.radians(col(bearing)), col(km) / EARTH_KM
    to = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(b))
    east = o + F.atan2(F.sin(b) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(to))
    return F.degrees(to), F.degrees(east)


def speed_kmh(km, ms) -> Column:
    """0 where no time has passed."""
    return F.when(col(ms) > 0, col(km) / (col(ms) / 3600000.0)).otherwise(0.0)


def in_box(lat, lon, min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> Column:
    """Edges belong to the box; one that runs over the antimeridian (min_lon > max_lon or beyond 180) is split in two."""
    rows = col(lat).between(min_lat, max_lat)
    if max_lon - min_lon >= 360:
        return rows
    if min_lon < -180 or max_lon > 180:
        min_lon, max_lon = (min_lon + 180) % 360 - 180, (max_lon + 180) % 360 - 180
    if min_lon > max_lon:
        return rows & ((col(lon) >= min_lon) | (col(lon) <= max_lon))
    return rows & col(lon).between(min_lon, max_lon)


def radius_box(lat: float, lon: float, km: float) -> tuple[float, float, float, float]:
    """Box (min_lat, min_lon, max_lat, max_lon) that holds the circle: longitudes are widened as meridians converge, to all near a pole."""
    d = math.degrees(km / EARTH_KM)
    low, high = max(-90.0, lat - d), min(90.0, lat + d)
    if low <= -90 or high >= 90:
        return low, -180.0, high, 180.0
    s = math.sin(km / EARTH_KM) / math.cos(math.radians(lat))
    w = 180.0 if s >= 1 else math.degrees(math.asin(s))
    return low, lon - w, high, lon + w


def within_km(lat, lon, at_lat: float, at_lon: float, km: float) -> Column:
    """Exact radius test behind a box test, which reaches the scan's min/max statistics. No radius, no rows."""
    if km <= 0:
        return F.lit(False)
    return in_box(lat, lon, *radius_box(at_lat, at_lon, km)) & (haversine_km(lat, lon, at_lat, at_lon) <= km)


def point_rect_m(lat, lon, min_lat, min_lon, max_lat, max_lon) -> Column:
    """Great-circle metres from a point to a box (0 inside): straight along a meridian if the point lies between the box's, else to a
    corner, or to the nearer edge where the foot of the perpendicular falls on it."""
    q, p = F.radians(col(lat)), F.radians(col(lon))
    s, w, n, e = (F.radians(col(x)) for x in (min_lat, min_lon, max_lat, max_lon))
    turn = lambda x: F.when(x < 0, x + 2 * math.pi).otherwise(x)
    to_w, to_e = turn(w - p), turn(p - e)
    d, edge = F.least(to_w, to_e), F.when(to_w <= to_e, w).otherwise(e)

    def angle(a2: Column, o2: Column) -> Column:
        h = F.pow(F.sin((q - a2) / 2), 2) + F.pow(F.sin((p - o2) / 2), 2) * F.cos(q) * F.cos(a2)
        return F.asin(F.least(F.lit(1.0), F.sqrt(h))) * 2

    corner_split = F.when(F.tan(q) >= F.tan((n + s) / 2) * F.cos(d), angle(n, edge)).otherwise(angle(s, edge))
    beside = F.when(F.tan(q) >= F.tan(n) * F.cos(d), angle(n, edge)).when(F.tan(q) <= F.tan(s) * F.cos(d), angle(s, edge)).otherwise(F.asin(F.cos(q) * F.sin(d)))
    out = F.when((s >= n) & (w >= e), angle(s, w))
    out = out.when((w <= p) & (p <= e), F.when(q < s, s - q).when(q > n, q - n).otherwise(0.0))
    return out.when(d >= math.pi / 2, corner_split).otherwise(beside) * EARTH_M


def in_sector(lat, lon, at_lat: float, at_lon: float, meters: float, start: float, end: float) -> Column:
    """Pie slice between two bearings, clockwise. Equal bearings are an error: that is a circle."""
    if start % 360 == end % 360:
        raise ValueError("equal bearings: use CIRCLE instead")
    b = heading(at_lat, at_lon, lat, lon)
    a, z = start % 360, end % 360
    turned = b.between(a, z) if a < z else (b >= a) | (b <= z)
    return within_km(lat, lon, at_lat, at_lon, meters / 1000) & turned


def dms(degrees) -> Column:
    """Struct of sign, degrees, minutes, seconds."""
    x = F.abs(col(degrees))
    d = F.floor(x)
    m = F.floor((x - d) * 60)
    return F.struct(F.signum(col(degrees)).cast("int").alias("sign"), d.cast("int").alias("degrees"), m.cast("int").alias("minutes"), ((x - d) * 3600 - m * 60).alias("seconds"))


def normal_lon(lon) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(col(lon) + 180.0, F.lit(360.0)) - 180.0
