"""Spatial aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import geohash, geohash_box, grid_cell, grid_step
from ..functions.geodesy import haversine_km


def by_geohash(points: DataFrame, precision: int, with_ids: bool = False) -> DataFrame:
    """Cells with count, centroid and box. with_ids gathers a cell's ids, which can be as many as its rows."""
    aggs = [F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon")]
    if with_ids:
        aggs.append(F.sort_array(F.collect_list("id")).alias("ids"))
    return points.groupBy(geohash("lat", "lon", precision).alias("cell")).agg(*aggs).withColumn("box", geohash_box("cell"))


def by_grid(points: DataFrame, km: float) -> DataFrame:
    """Cells of a km grid with count, centroid and box."""
    y, x = grid_cell("lat", "lon", km)
    s = grid_step(km)
    rows = points.groupBy(y.alias("y"), x.alias("x")).agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    box = F.struct((F.col("y") * s).alias("min_lat"), (F.col("x") * s).alias("min_lon"), ((F.col("y") + 1) * s).alias("max_lat"), ((F.col("x") + 1) * s).alias("max_lon"))
    return rows.select(F.concat_ws(":", "y", "x").alias("cell"), "n", "lat", "lon", box.alias("box"))


def extent(points: DataFrame, *keys: str) -> DataFrame:
    return points.groupBy(*keys).agg(F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"))


def statistics(points: DataFrame, *keys: str) -> DataFrame:
    """Count, centroid, box, population deviations and the box's diagonal in km."""
    rows = points.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.stddev_pop("lat").alias("std_lat"), F.stddev_pop("lon").alias("std_lon"),
        F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"),
    )
    return rows.withColumn("spread_km", haversine_km("min_lat", "min_lon", "max_lat", "max_lon"))


def key_stats(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """For each wanted key: objects, points and strings; nulls for a key without objects."""
    found = objects.groupBy("key").agg(F.count("*").alias("num_objects"), F.sum("n_points").alias("num_points"), F.count_if(F.col("value").isNotNull()).alias("num_strings"))
    return keys.join(found, "key", "left")


def tag_counts(elements: DataFrame) -> DataFrame:
    """Objects by tag key, value and kind: key, value, node, way, relation, total. elements: kind, tags."""
    rows = elements.select("kind", F.explode("tags").alias("key", "value"))
    per = rows.groupBy("key", "value").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("node", "way", "relation")], F.count("*").alias("total"))
    return per


def merged_tags(records: DataFrame) -> DataFrame:
    """One map per group from records (grp, idx, tags): tags with one value in all of them stay, others become key.idx."""
    sizes = records.groupBy("grp").agg(F.count("*").alias("size"))
    tags = records.select("grp", "idx", F.explode("tags").alias("k", "v"))
    same = tags.groupBy("grp", "k").agg(F.count("*").alias("n"), F.count_distinct("v").alias("values"))
    rows = tags.join(same, ["grp", "k"]).join(sizes, "grp")
    whole = (F.col("n") == F.col("size")) & (F.col("values") == 1)
    name = F.when(whole, F.col("k")).otherwise(F.concat_ws(".", "k", "idx"))
    return rows.select("grp", name.alias("name"), "v").distinct()
