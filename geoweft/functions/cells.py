"""Cell codes as Column expressions: geohash, km grid, Hilbert, cube-face cells, quadrants."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geodesy import EARTH_KM, col

#: Fixed value: the geohash alphabet.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def scaled(x, low: float, span: float, bits: int) -> Column:
    """Cell number of a coordinate among 2^bits equal cells; the upper edge belongs to the last."""
    return F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), F.floor((col(x) - low) / span * float(1 << bits)))).cast("long")


def geohash(lat, lon, precision: int) -> Column:
    """Base-32 code of 1 to 12 characters; longitude bits come first."""
    if not 1 <= precision <= 12:
        raise ValueError("precision must be 1 to 12")
    bits = 5 * precision
    nlon, nlat = (bits + 1) // 2, bits // 2
    x, y = scaled(lon, -180.0, 360.0, nlon), scaled(lat, -90.0, 180.0, nlat)
    chars = []
    for c in range(precision):
        value = []
        for j in range(5):
            b = 5 * c + j
            source, shift = (x, nlon - 1 - b // 2) if b % 2 == 0 else (y, nlat - 1 - b // 2)
            value.append(F.shiftleft(F.shiftright(source, shift).bitwiseAND(1), 4 - j))
        chars.append(F.substring(F.lit(BASE32), (reduce(lambda a, b: a + b, value) + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def geohash_box(code) -> Column:
    """Struct min_lat, min_lon, max_lat, max_lon of a code; null if it has a character outside the alphabet."""
    h, n = col(code), F.length(col(code)) * 5

    def part(parity: int) -> Column:
        index = lambda b: F.call_function("locate", F.substring(h, (F.floor(b / 5) + 1).cast("int"), F.lit(1)), F.lit(BASE32)) - 1
        bit = lambda b: F.call_function("shiftright", index(b), (4 - b % 5).cast("int")).bitwiseAND(1)
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda acc, b: F.when(b % 2 == parity, acc * 2 + bit(b)).otherwise(acc))

    x, y, sx, sy = part(0), part(1), F.pow(F.lit(2.0), F.ceil(n / 2)), F.pow(F.lit(2.0), F.floor(n / 2))
    box = F.struct((y * 180.0 / sy - 90).alias("min_lat"), (x * 360.0 / sx - 180).alias("min_lon"), ((y + 1) * 180.0 / sy - 90).alias("max_lat"), ((x + 1) * 360.0 / sx - 180).alias("max_lon"))
    return F.when(h.rlike(f"^[{BASE32}]+$"), box)


def geohash_neighbours(lat, lon, precision: int) -> Column:
    """Codes N, NE, E, SE, S, SW, W, NW of the cell that holds a point; cells beyond an edge fold onto the last ones."""
    dy, dx = 180.0 / (1 << (5 * precision // 2)), 360.0 / (1 << ((5 * precision + 1) // 2))
    steps = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))
    return F.array(*[geohash(col(lat) + a * dy, col(lon) + b * dx, precision) for a, b in steps])


def geohash_parent(code) -> Column:
    return F.substring(col(code), F.lit(1), F.greatest(F.length(col(code)) - 1, F.lit(0)))


def geohash_cover(min_lat: float, min_lon: float, max_lat: float, max_lon: float, precision: int, most: int = 100_000) -> list[tuple[int, int]]:
    """Cell numbers (x, y) that a box touches; an error beyond `most`, never a part of them."""
    nlon, nlat = (5 * precision + 1) // 2, 5 * precision // 2
    at = lambda v, low, span, n: min((1 << n) - 1, max(0, math.floor((v - low) / span * (1 << n))))
    xs = range(at(min_lon, -180, 360, nlon), at(max_lon, -180, 360, nlon) + 1)
    ys = range(at(min_lat, -90, 180, nlat), at(max_lat, -90, 180, nlat) + 1)
    if len(xs) * len(ys) > most:
        raise ValueError(f"{len(xs) * len(ys)} cells cover the box: use a lower precision")
    return [(x, y) for y in ys for x in xs]


def grid_step(km: float) -> float:
    return math.degrees(km / EARTH_KM)


def grid_cell(lat, lon, km: float) -> tuple[Column, Column]:
    """Row and column of a grid of about so many km (the same step in both directions)."""
    return F.floor(col(lat) / grid_step(km)).cast("long"), F.floor(col(lon) / grid_step(km)).cast("long")


def hilbert(lat, lon, order: int) -> Column:
    """Position of the world cell on the Hilbert curve of this order."""
    state = F.struct(scaled(lon, -180.0, 360.0, order).alias("x"), scaled(lat, -90.0, 180.0, order).alias("y"), F.lit(0).cast("long").alias("d"))
    return hilbert_of(state, order)


def hilbert_of(state: Column, order: int) -> Column:
    def step(v: Column, i: Column) -> Column:
        s = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(order - 1) - i).cast("int"))
        rx, ry = (v["x"].bitwiseAND(s) > 0).cast("long"), (v["y"].bitwiseAND(s) > 0).cast("long")
        flip = (ry == 0) & (rx == 1)
        x, y = F.when(flip, s - 1 - v["x"]).otherwise(v["x"]), F.when(flip, s - 1 - v["y"]).otherwise(v["y"])
        return F.struct(F.when(ry == 0, y).otherwise(x).alias("x"), F.when(ry == 0, x).otherwise(y).alias("y"), (v["d"] + s * s * (rx * 3).bitwiseXOR(ry)).alias("d"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(order - 1)), state, step)["d"]


def hilbert16(min_x, min_y, max_x, max_y, world: tuple[float, float, float, float]) -> Column:
    """16-bit Hilbert code of a box's centre within world bounds, the order of packed spatial files."""
    x0, y0, x1, y1 = world
    at = lambda a, b, low, span: F.least(F.lit(65535), F.greatest(F.lit(0), F.floor(((col(a) + col(b)) / 2 - low) / span * 65535))).cast("long") if span > 0 else F.lit(0).cast("long")
    return hilbert_of(F.struct(at(min_x, max_x, x0, x1 - x0).alias("x"), at(min_y, max_y, y0, y1 - y0).alias("y"), F.lit(0).cast("long").alias("d")), 16)


def face_cell(lat, lon, level: int) -> Column:
    """Cube-face cell: face, then column and row of the face's 2^level grid, then a closing 1 bit. Not compatible with other libraries' cells."""
    a, o = F.radians(col(lat)), F.radians(col(lon))
    x, y, z = F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    face = F.when((ax >= ay) & (ax >= az), F.when(x >= 0, 0).otherwise(3)).when(ay >= az, F.when(y >= 0, 1).otherwise(4)).otherwise(F.when(z >= 0, 2).otherwise(5))
    pick = lambda *xs: reduce(lambda c, i: c.when(face == i, xs[i]), range(1, 6), F.when(face == 0, xs[0]))
    u = pick(y / x, -x / y, -x / z, z / x, z / y, -y / z)
    v = pick(z / x, z / y, -y / z, y / x, -x / y, -x / z)
    cell = lambda w: F.least(F.floor((w + 1) / 2 * float(1 << level)), F.lit((1 << level) - 1)).cast("long")
    return F.shiftleft(face.cast("long"), 2 * level + 1).bitwiseOR(F.shiftleft(cell(u), level + 1)).bitwiseOR(cell(v)).bitwiseOR(1)


def face_cell_level(cell) -> Column:
    """From the lowest set bit; -1 for 0."""
    low = F.bit_count(col(cell).bitwiseAND(-col(cell)) - 1)
    return F.when(col(cell) == 0, F.lit(-1)).otherwise(F.floor((60 - low) / 2)).cast("int")


def face_cell_parent(cell, level: int) -> Column:
    bits = 2 * (30 - level)
    return col(cell).bitwiseAND(~((1 << bits) - 1)).bitwiseOR(1 << (bits - 1))


def face_cell_contains(cell, other) -> Column:
    c = col(cell)
    return (col(other) >= c) & (col(other) <= c + c.bitwiseAND(-c) * 2 - 1)


def face_cell_token(cell) -> Column:
    return F.lower(F.hex(col(cell)))


def quadrant(lat, lon, mid_lat, mid_lon) -> Column:
    """0 NW, 1 NE, 2 SW, 3 SE."""
    return F.when(col(lat) >= col(mid_lat), 0).otherwise(2) + F.when(col(lon) >= col(mid_lon), 1).otherwise(0)
