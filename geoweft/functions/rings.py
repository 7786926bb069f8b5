"""Rings as arrays of struct<lat, lon> in Column expressions: containment, areas, lengths, centres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geodesy import EARTH_KM, col, haversine_km


def ring(points: list[tuple[float, float]]) -> Column:
    """A constant ring of (lat, lon) vertices, not closed."""
    return F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(o)).alias("lon")) for a, o in points])


def edges(r: Column) -> Column:
    """Array of struct a, b: each vertex with the next, the last with the first."""
    return F.transform(r, lambda p, i: F.struct(p.alias("a"), F.get(r, (i + 1) % F.size(r)).alias("b")))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def contains(r: Column, lat, lon) -> Column:
    """Even-odd ray cast; fewer than three vertices contain nothing; points on an edge fall to either side."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lon"] > col(lon)) != (b["lon"] > col(lon))
        return spans & (col(lat) < (b["lat"] - a["lat"]) * (col(lon) - a["lon"]) / F.nullif(b["lon"] - a["lon"], F.lit(0.0)) + a["lat"])

    return (F.size(r) >= 3) & (F.size(F.filter(edges(r), crosses)) % 2 == 1)


def signed_area(r: Column) -> Column:
    """Shoelace area in square degrees on (lat, lon) axes."""
    return total(F.transform(edges(r), lambda e: e["a"]["lat"] * e["b"]["lon"] - e["b"]["lat"] * e["a"]["lon"])) / 2


def clockwise(r: Column) -> Column:
    return signed_area(r) < 0


def area_km2(r: Column) -> Column:
    part = lambda e: F.radians(e["b"]["lon"] - e["a"]["lon"]) * (2 + F.sin(F.radians(e["a"]["lat"])) + F.sin(F.radians(e["b"]["lat"])))
    return F.when(F.size(r) < 3, 0.0).otherwise(F.abs(total(F.transform(edges(r), part))) * (EARTH_KM * EARTH_KM / 2))


def perimeter_km(r: Column) -> Column:
    return total(F.transform(edges(r), lambda e: haversine_km(e["a"]["lat"], e["a"]["lon"], e["b"]["lat"], e["b"]["lon"])))


def mean_vertex(r: Column) -> Column:
    """Struct lat, lon."""
    mean = lambda f: total(F.transform(r, lambda p: p[f])) / F.size(r)
    return F.struct(mean("lat").alias("lat"), mean("lon").alias("lon"))


def box(r: Column) -> Column:
    side = lambda f, g: g(F.transform(r, lambda p: p[f]))
    return F.struct(side("lat", F.array_min).alias("min_lat"), side("lon", F.array_min).alias("min_lon"), side("lat", F.array_max).alias("max_lat"), side("lon", F.array_max).alias("max_lon"))


def overlap(a: Column, b: Column) -> Column:
    """A vertex of one lies in the other (crossing shapes without such a vertex are not found)."""
    inside = lambda x, y: F.exists(x, lambda p: contains(y, p["lat"], p["lon"]))
    return inside(a, b) | inside(b, a)


def grown(r: Column, distance: float) -> Column:
    """Vertices moved away from the mean vertex by the factor 1 + distance / 100."""
    c, k = mean_vertex(r), 1 + distance / 100
    return F.transform(r, lambda p: F.struct((c["lat"] + (p["lat"] - c["lat"]) * k).alias("lat"), (c["lon"] + (p["lon"] - c["lon"]) * k).alias("lon")))


def segment_km(lat, lon, a: Column, b: Column) -> Column:
    """Haversine km to the nearest point of a segment, found on plain degrees."""
    dx, dy = b["lat"] - a["lat"], b["lon"] - a["lon"]
    n = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((col(lat) - a["lat"]) * dx + (col(lon) - a["lon"]) * dy) / F.nullif(n, F.lit(0.0))))
    t = F.coalesce(t, F.lit(0.0))
    return haversine_km(lat, lon, a["lat"] + t * dx, a["lon"] + t * dy)
