"""Searches over points: radius, box, nearest, thinning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import haversine_km, in_box, within_km


def radius_search(points: DataFrame, lat: float, lon: float, km: float, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Points within the radius by distance, then id."""
    out = points.where(within_km("lat", "lon", lat, lon, km)).withColumn("dist_km", haversine_km("lat", "lon", lat, lon))
    return page(out.orderBy("dist_km", "id"), limit, offset)


def box_search(points: DataFrame, min_lat: float, min_lon: float, max_lat: float, max_lon: float, order: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Points of a box, once for each id, optionally by time ('asc' or 'desc')."""
    out = points.where(in_box("lat", "lon", min_lat, min_lon, max_lat, max_lon)).dropDuplicates(["id"])
    if order:
        out = out.orderBy(F.col("ts").asc() if order == "asc" else F.col("ts").desc(), "id")
    return page(out, limit, offset)


def page(rows: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def nearest(points: DataFrame, lat: float, lon: float, k: int, max_km: float | None = None, collections: list[str] | None = None) -> DataFrame:
    """Exact k nearest, over some collections if given; one top-k pass, no sort of all rows."""
    if collections is not None:
        points = points.where(F.col("collection").isin(collections))
    if max_km is not None:
        points = points.where(within_km("lat", "lon", lat, lon, max_km))
    return points.withColumn("dist_km", haversine_km("lat", "lon", lat, lon)).orderBy("dist_km", "id").limit(k)


def sparse(points: DataFrame, min_lat: float, min_lon: float, max_lat: float, max_lon: float, level: int) -> DataFrame:
    """One point (the least id) of each of the 4^level cells of the area; level 1 to 16."""
    if not 1 <= level <= 16:
        raise ValueError("SPARSE level must be 1 to 16")
    n = 1 << level
    at = lambda c, low, span: F.least(F.floor((F.col(c) - low) / span * n), F.lit(n - 1)).cast("int")
    rows = points.where(in_box("lat", "lon", min_lat, min_lon, max_lat, max_lon))
    rows = rows.withColumn("cell_x", at("lon", min_lon, max_lon - min_lon)).withColumn("cell_y", at("lat", min_lat, max_lat - min_lat))
    return rows.groupBy("cell_x", "cell_y").agg(F.min_by(F.struct(*points.columns), "id").alias("p")).select("p.*", "cell_x", "cell_y")


def last_write(log: DataFrame, keys: list[str], seq: str = "seq", deleted: str = "deleted") -> DataFrame:
    """The newest version of each key, without those whose newest version is a deletion."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("v")).select(*keys, *[f"v.{c}" for c in rest]).where(~F.col(deleted)).drop(deleted)


def keyset_page(rows: DataFrame, after, limit: int, key: str = "id") -> DataFrame:
    """The next page after a key, without state on a server."""
    rows = rows if after is None else rows.where(F.col(key) > after)
    return rows.orderBy(key).limit(limit)


def str_packed(points: DataFrame, partitions: int) -> DataFrame:
    """Strips by longitude, each sorted by latitude: a layout whose files have narrow statistics."""
    return points.repartitionByRange(partitions, "lon").sortWithinPartitions("lat")


def last_points(track: DataFrame, n: int) -> DataFrame:
    """The newest n points of each object."""
    w = Window.partitionBy("id").orderBy(F.desc("ts"), F.desc("seq"))
    return track.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)
