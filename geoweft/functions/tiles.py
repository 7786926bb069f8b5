"""Web map tiles as Column expressions: pixels, tiles, quadkeys, slippy tiles, Mercator."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geodesy import col

#: Latitude limit of square web maps, Mercator radius.
MAX_LAT = 85.05112878
EARTH_M = 6378137.0


def pixel(lat, lon, level: int) -> tuple[Column, Column]:
    """Pixel column and row at a level of detail, rounded, within the map."""
    size = float(256 << level)
    a = F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), col(lat)))
    o = F.greatest(F.lit(-180.0), F.least(F.lit(180.0), col(lon)))
    s = F.sin(F.radians(a))
    inside = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(size - 1), v * size + 0.5)).cast("long")
    return inside((o + 180.0) / 360.0), inside(F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * math.pi))


def tile(lat, lon, level: int) -> tuple[Column, Column]:
    x, y = pixel(lat, lon, level)
    return F.shiftright(x, 8), F.shiftright(y, 8)


def pixel_point(x, y, level: int) -> tuple[Column, Column]:
    """Latitude and longitude of a pixel."""
    size = float(256 << level)
    inside = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(size - 1), col(v).cast("double"))) / size
    return 90 - F.atan(F.exp(-(F.lit(0.5) - inside(y)) * (2 * math.pi))) * (360 / math.pi), (inside(x) - 0.5) * 360


def tile_box(x, y, level: int) -> Column:
    """Struct min_lat, min_lon, max_lat, max_lon; tiles at the map's edge reach the edge of the world."""
    last = (1 << level) - 1
    top, left = pixel_point(F.shiftleft(col(x), 8), F.shiftleft(col(y), 8), level)
    bottom, right = pixel_point(F.shiftleft(col(x) + 1, 8), F.shiftleft(col(y) + 1, 8), level)
    column = F.pmod(col(x), F.lit(1 << level))
    return F.struct(
        F.when(col(y) >= last, -MAX_LAT).otherwise(bottom).alias("min_lat"), F.when(column == 0, -180.0).otherwise(left).alias("min_lon"),
        F.when(col(y) <= 0, MAX_LAT).otherwise(top).alias("max_lat"), F.when(column == last, 180.0).otherwise(right).alias("max_lon"),
    )


def quadkey(x, y, level: int) -> Column:
    """One digit a level, 1 for east plus 2 for south, coarsest first."""
    digit = lambda i: (F.shiftright(col(x), i).bitwiseAND(1) + F.shiftright(col(y), i).bitwiseAND(1) * 2).cast("string")
    return F.concat(*[digit(i) for i in range(level - 1, -1, -1)]) if level else F.lit("")


def quadkey_tile(key) -> Column:
    """Struct x, y, level; null if a digit is not 0 to 3."""
    k = col(key)
    part = lambda bit: F.aggregate(F.filter(F.split(k, ""), lambda d: d != ""), F.lit(0).cast("long"), lambda acc, d: acc * 2 + F.shiftright(d.cast("int"), bit).bitwiseAND(1))
    return F.when(k.rlike("^[0-3]*$"), F.struct(part(0).alias("x"), part(1).alias("y"), F.length(k).alias("level")))


def slippy(lat, lon, zoom: int) -> tuple[Column, Column]:
    """Tile of the usual web tiling, clamped to the map."""
    n = float(1 << zoom)
    a = F.radians(F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), col(lat))))
    inside = lambda v: F.greatest(F.lit(0), F.least(F.lit((1 << zoom) - 1), F.floor(v * n))).cast("long")
    return inside((col(lon) + 180) / 360), inside((1 - F.log(F.tan(a) + 1 / F.cos(a)) / math.pi) / 2)


def tile_family(x: int, y: int, z: int, zoom: int) -> list[tuple[int, int]]:
    """The tile's ancestor at a lower zoom, or all its descendants at a higher one."""
    if zoom <= z:
        return [(x >> (z - zoom), y >> (z - zoom))]
    d = zoom - z
    return [((x << d) + i, (y << d) + j) for i in range(1 << d) for j in range(1 << d)]


def mercator(lat, lon) -> tuple[Column, Column]:
    """Spherical Mercator metres x, y."""
    return F.radians(col(lon)) * EARTH_M, F.log(F.tan(F.radians(col(lat)) / 2 + math.pi / 4)) * EARTH_M


def mercator_inverse(x, y) -> tuple[Column, Column]:
    """Latitude, longitude of Mercator metres."""
    return F.degrees(F.atan(F.exp(col(y) / EARTH_M)) * 2 - math.pi / 2), F.degrees(col(x) / EARTH_M)


def pixel_width(zoom: int, tile_size: int = 256, latitude: float = 0.0) -> float:
    """Metres that a pixel spans."""
    return 2 * math.pi * EARTH_M * math.cos(math.radians(latitude)) / (tile_size << zoom)


def cover(min_lat, min_lon, max_lat, max_lon, zoom: int) -> Column:
    """Array of struct x, y: the tiles that a box touches, by rows from the north."""
    (x0, y1), (x1, y0) = slippy(min_lat, min_lon, zoom), slippy(max_lat, max_lon, zoom)
    return F.flatten(F.transform(F.sequence(y0, y1), lambda y: F.transform(F.sequence(x0, x1), lambda x: F.struct(x.alias("x"), y.alias("y")))))
