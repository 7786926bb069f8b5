"""Search areas from command words, as tests of point columns and as shapes."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import cells, geodesy, rings, tiles
from ..functions import geometry as geo


@dataclass
class Area:
    """point(lat, lon): test of a point; shape: for tests of other geometries; box: min_lat, min_lon, max_lat, max_lon."""

    point: object
    shape: dict
    box: tuple[float, float, float, float]
    centre: tuple[float, float] | None = None
    meters: float | None = None
    negated: bool = False
    parts: list = field(default_factory=list)


def box_area(min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> Area:
    test = lambda lat, lon: geodesy.in_box(lat, lon, min_lat, min_lon, max_lat, max_lon)
    return Area(test, geo.rectangle(min_lon, min_lat, max_lon, max_lat), (min_lat, min_lon, max_lat, max_lon))


def circle_area(lat: float, lon: float, meters: float) -> Area:
    test = lambda a, o: geodesy.within_km(a, o, lat, lon, meters / 1000)
    return Area(test, geo.circle(lon, lat, meters), geodesy.radius_box(lat, lon, meters / 1000), (lat, lon), meters)


def shape_area(shape: dict) -> Area:
    b = geo.bounds(shape)
    if b is None:
        return Area(lambda lat, lon: F.lit(False), shape, (0, 0, -1, -1))
    box = (b[1], b[0], b[3], b[2])
    points, lines, polys = geo.parts(shape)

    def test(lat: Column, lon: Column) -> Column:
        inside = F.lit(False)
        for poly in polys:
            held = [rings.contains(rings.ring([(p[1], p[0]) for p in r]), lat, lon) for r in poly]
            on_edge = F.lit(False)
            for a, b in (s for r in poly for s in geo.segments(r, True)):
                on_edge = on_edge | on(lat, lon, a, b)
            here = held[0]
            for hole in held[1:]:
                here = here & ~hole
            inside = inside | here | on_edge
        for a, b in (s for x in lines for s in geo.segments(x)):
            inside = inside | on(lat, lon, a, b)
        for p in points:
            inside = inside | ((lat == p[1]) & (lon == p[0]))
        return geodesy.in_box(lat, lon, *box) & inside

    return Area(test, shape, box)


def on(lat: Column, lon: Column, a, b) -> Column:
    cross = (lat - a[1]) * (b[0] - a[0]) - (lon - a[0]) * (b[1] - a[1])
    return (cross == 0) & lon.between(min(a[0], b[0]), max(a[0], b[0])) & lat.between(min(a[1], b[1]), max(a[1], b[1]))


def sector_area(lat: float, lon: float, meters: float, start: float, end: float) -> Area:
    test = lambda a, o: geodesy.in_sector(a, o, lat, lon, meters, start, end)
    test(F.lit(0.0), F.lit(0.0))
    arc = (end - start) % 360
    n = max(2, math.ceil(arc / 360 * 64))
    ring = [[lon, lat]]
    for i in range(n + 1):
        b, d, a = math.radians(start + arc * i / n), meters / geodesy.EARTH_M, math.radians(lat)
        y = math.asin(math.sin(a) * math.cos(d) + math.cos(a) * math.sin(d) * math.cos(b))
        x = math.radians(lon) + math.atan2(math.sin(b) * math.sin(d) * math.cos(a), math.cos(d) - math.sin(a) * math.sin(y))
        ring.append([math.degrees(x), math.degrees(y)])
    return Area(test, {"type": "Polygon", "coordinates": [[*ring, ring[0]]]}, geodesy.radius_box(lat, lon, meters / 1000))


def hash_box(code: str) -> tuple[float, float, float, float]:
    lat, lon, odd = [-90.0, 90.0], [-180.0, 180.0], True
    for c in code:
        if c not in cells.BASE32:
            raise ValueError(f"invalid geohash {code!r}")
        for i in range(4, -1, -1):
            side = lon if odd else lat
            side[1 - (cells.BASE32.index(c) >> i & 1)] = sum(side) / 2
            odd = not odd
    return lat[0], lon[0], lat[1], lon[1]


def tile_bounds(x: int, y: int, z: int) -> tuple[float, float, float, float]:
    n = 1 << z
    up = lambda v: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * v / n))))
    limit = tiles.MAX_LAT
    return -limit if y >= n - 1 else up(y + 1), -180.0 if x % n == 0 else x / n * 360 - 180, limit if y <= 0 else up(y), 180.0 if x % n == n - 1 else (x + 1) / n * 360 - 180


def quadkey_bounds(key: str) -> tuple[float, float, float, float]:
    if set(key) - set("0123"):
        raise ValueError("invalid quadkey")
    x = int("".join(str(int(d) & 1) for d in key) or "0", 2)
    y = int("".join(str(int(d) >> 1) for d in key) or "0", 2)
    return tile_bounds(x, y, len(key))


class Words:
    """Command words, taken from the left."""

    def __init__(self, words: list[str]):
        self.words, self.at = words, 0

    def peek(self) -> str:
        return self.words[self.at].upper() if self.at < len(self.words) else ""

    def take(self) -> str:
        if self.at >= len(self.words):
            raise ValueError("wrong number of arguments")
        self.at += 1
        return self.words[self.at - 1]

    def end(self) -> None:
        if self.at < len(self.words):
            raise ValueError(f"invalid argument {self.words[self.at]!r}")

    def number(self, low: float = -math.inf, high: float = math.inf) -> float:
        raw = self.take()
        try:
            x = float(raw)
        except ValueError:
            raise ValueError(f"invalid argument {raw!r}") from None
        if not (math.isfinite(x) and low <= x <= high):
            raise ValueError(f"invalid argument {raw!r}")
        return x


def geojson(text: str) -> dict:
    try:
        return geo.from_geojson(text)
    except (json.JSONDecodeError, KeyError, TypeError) as e:
        raise ValueError("invalid geojson") from e


def area(words: Words, stored=None) -> Area:
    """One area. stored(key, id) gives the shape of a stored object for GET."""
    kind = words.take().upper()
    if kind == "CIRCLE":
        return circle_area(words.number(-90, 90), words.number(-180, 180), words.number(0))
    if kind == "POINT":
        lat, lon = words.number(-90, 90), words.number(-180, 180)
        return shape_area({"type": "Point", "coordinates": [lon, lat]})
    if kind == "BOUNDS":
        return box_area(*[words.number() for _ in range(4)])
    if kind == "HASH":
        return box_area(*hash_box(words.take()))
    if kind == "QUADKEY":
        return box_area(*quadkey_bounds(words.take()))
    if kind == "TILE":
        x, y, z = int(words.number()), int(words.number()), int(words.number(0, 23))
        return box_area(*tile_bounds(x, y, z))
    if kind == "SECTOR":
        return sector_area(words.number(-90, 90), words.number(-180, 180), words.number(0), words.number(), words.number())
    if kind == "OBJECT":
        return shape_area(geojson(words.take()))
    if kind == "GET" and stored:
        found = stored(words.take(), words.take())
        if found is None:
            raise ValueError("id not found")
        return shape_area(found)
    raise ValueError(f"invalid argument {kind!r}")


def expression(words: Words, stored=None):
    """Areas with ( ) NOT AND OR, AND binding tighter, as a function of a test: expr(f) combines f(area) over the tree."""

    def either():
        left = both()
        while words.peek() == "OR":
            words.take()
            left = (lambda a, b: lambda f: a(f) | b(f))(left, both())
        return left

    def both():
        left = one()
        while words.peek() == "AND":
            words.take()
            left = (lambda a, b: lambda f: a(f) & b(f))(left, one())
        return left

    def one():
        if words.peek() == "NOT":
            words.take()
            inner = one()
            return lambda f: ~inner(f)
        if words.peek() == "(":
            words.take()
            inner = either()
            if words.take() != ")":
                raise ValueError("missing )")
            return inner
        a = area(words, stored)
        return lambda f: f(a)

    return either()
