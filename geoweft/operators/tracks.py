"""Trajectories from positions (id, ts in ms, seq, lat, lon)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import destination, haversine_km, heading, speed_kmh


def steps(positions: DataFrame) -> DataFrame:
    """Distance, speed and heading since the object's previous position; a step without time has speed 0, the first has zeros."""
    w = Window.partitionBy("id").orderBy("ts", "seq")
    rows = positions.withColumns({f"last_{c}": F.lag(c).over(w) for c in ("lat", "lon", "ts")})
    first = F.col("last_ts").isNull()
    km = haversine_km("last_lat", "last_lon", "lat", "lon")
    return rows.withColumn("dt", F.greatest(F.coalesce(F.col("ts") - F.col("last_ts"), F.lit(0)), F.lit(0))).withColumn("km", F.when(first, 0.0).otherwise(km)).withColumn("speed_kmh", speed_kmh("km", "dt")).withColumn("heading", F.when(first, 0.0).otherwise(heading("last_lat", "last_lon", "lat", "lon")))


def statistics(positions: DataFrame) -> DataFrame:
    rows = steps(positions).groupBy("id").agg(
        F.count("*").alias("n"), F.sum("km").alias("km"), F.max("speed_kmh").alias("max_speed"), (F.max("ts") - F.min("ts")).alias("duration_ms"),
        F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"),
    )
    return rows.withColumn("avg_speed", speed_kmh("km", "duration_ms"))


def predicted(positions: DataFrame, ahead_ms: int) -> DataFrame:
    """Each object's position after so long at its last speed and heading; where it is, if it stands."""
    last = steps(positions).groupBy("id").agg(F.max_by(F.struct("lat", "lon", "speed_kmh", "heading"), F.struct("ts", "seq")).alias("p")).select("id", "p.*")
    lat, lon = destination("lat", "lon", "heading", F.col("speed_kmh") * (ahead_ms / 3600000.0))
    moves = F.col("speed_kmh") > 0
    return last.select("id", F.when(moves, lat).otherwise(F.col("lat")).alias("lat"), F.when(moves, lon).otherwise(F.col("lon")).alias("lon"))
