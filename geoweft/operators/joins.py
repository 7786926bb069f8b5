"""Spatial joins as equi-joins on cells with an exact test behind, so no join compares all pairs.

The sphere is cut into latitude bands of `step` degrees and each band into cells of about the same width in km, so cells do not
multiply towards the poles. A left row has one cell; a right row is copied to the cells that its circle touches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, TimestampType

from ..functions.geodesy import EARTH_KM, haversine_km
from ..shared import settled

HALF_ROUND = math.pi * EARTH_KM
SMALL = 10_000  # rows of a table that may be broadcast whole
UNIT = 20_000_000  # pairs of one cell that are compared in one place
LEVELS = 14  # halvings of the first radius that k-nearest joins count right rows at


def band_cells(band: Column, step: float | Column) -> Column:
    """How many cells a band has."""
    edge = F.greatest(F.abs(band * step), F.abs((band + 1) * step))
    return F.greatest(F.lit(1), F.floor(F.cos(F.radians(F.least(edge, F.lit(90.0)))) * (360.0 / step))).cast("int")


def own_cell(lat: Column, lon: Column, step: float | Column) -> Column:
    band = F.floor(lat / step).cast("int")
    n = band_cells(band, step)
    x = F.least(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n).cast("int"), n - 1)
    return F.struct(band.alias("band"), x.alias("x"))


def touched_cells(lat: Column, lon: Column, km: Column, step: float | Column) -> Column:
    """All cells that the circle touches, once each."""
    d = F.degrees(km / EARTH_KM) + 1e-9
    reach = F.sin(F.radians(d)) / F.cos(F.radians(lat))
    w = F.when((F.abs(lat) + d >= 90) | (d >= 90) | (reach >= 1), 180.0).otherwise(F.degrees(F.asin(F.least(reach, F.lit(1.0)))) + 1e-9)
    low, high = F.floor(F.greatest(lat - d, F.lit(-90.0)) / step).cast("int"), F.floor(F.least(lat + d, F.lit(90.0)) / step).cast("int")

    def row(band: Column) -> Column:
        n = band_cells(band, step)
        a, b = F.floor((lon - w + 180.0) / 360.0 * n).cast("int"), F.floor((lon + w + 180.0) / 360.0 * n).cast("int")
        xs = F.transform(F.sequence(a, F.least(b, a + n - 1)), lambda x: F.pmod(x, n))
        return F.transform(xs, lambda x: F.struct(band.alias("band"), x.alias("x")))

    return F.flatten(F.transform(F.sequence(low, high), row))


def radius_join(left: DataFrame, right: DataFrame, km, left_at: tuple[str, str] = ("lat", "lon"), right_at: tuple[str, str] = ("rlat", "rlon"), out: str = "dist_km", step: float | None = None) -> DataFrame:
    """Pairs of rows at most `km` apart (a number, or a column of the right side), with their distance. The sides share no column name.

    `step` is the band height in degrees; by default that of the radius. Rows without coordinates join nothing. Where a number of km and more
    than SMALL right rows are given, cells with many pairs are cut into parts of the left rows, and parts are dealt over tasks by their pairs.
    """
    even = isinstance(km, (int, float)) and right.limit(SMALL + 1).count() > SMALL
    radius = F.lit(float(km)) if isinstance(km, (int, float)) else F.col(km)
    if step is None:
        # half the radius where sides are large: more copies of the right rows, but fewer pairs beyond the radius
        step = max(0.001, min(45.0, math.degrees(km / EARTH_KM) / (2 if even else 1) if isinstance(km, (int, float)) else 1.0))
    at = [F.col(c) for c in (*left_at, *right_at)]
    a = left.where(at[0].isNotNull() & at[1].isNotNull()).withColumn("__cell", own_cell(at[0], at[1], step))
    b = right.where(at[2].isNotNull() & at[3].isNotNull()).withColumn("__touched", F.explode(touched_cells(at[2], at[3], radius, step)))
    on = (F.col("__cell.band") == F.col("__touched.band")) & (F.col("__cell.x") == F.col("__touched.x"))
    if even:
        a, b = dealt(a, b)
        on = (F.col("__a") == F.col("__b")) & (F.col("__apart") == F.col("__bpart"))
    pairs = a.join(b, on)
    return pairs.withColumn(out, haversine_km(*at)).where(F.col(out) <= radius).drop("__cell", "__touched", "__a", "__b", "__apart", "__bpart")


def dealt(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides by cell and part. A cell of more than UNIT pairs has several parts: each holds a share of the left rows and all right rows."""
    name = lambda c: F.col(f"{c}.band").cast("long") * F.lit(1 << 32) + F.col(f"{c}.x")
    a, b = a.withColumn("__a", name("__cell")), b.withColumn("__b", name("__touched"))
    m, n = a.groupBy(F.col("__a").alias("__of")).agg(F.count("*").alias("__m")), b.groupBy(F.col("__b").alias("__of")).agg(F.count("*").alias("__n"))
    pairs = F.col("__m").cast("double") * F.col("__n")
    cells = settled(m.join(n, "__of").select("__of", pairs.alias("__pairs"), F.ceil(pairs / UNIT).cast("int").alias("__parts")), "cell-pairs")
    total = cells.agg(F.sum("__pairs")).first()[0] or 0.0
    tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(20_000, math.ceil(total / (5 * UNIT))))
    plain = [f.name for f in a.schema if isinstance(f.dataType, (NumericType, StringType, TimestampType))]  # a repeated task deals rows alike
    hot = cells.where("__parts > 1").select("__of", "__parts")  # no more than one for each UNIT of pairs
    a = a.join(F.broadcast(hot), F.col("__a") == F.col("__of"), "left").withColumn("__apart", F.pmod(F.xxhash64(*plain), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__of", "__parts")
    b = b.join(F.broadcast(hot), F.col("__b") == F.col("__of"), "left").withColumn("__bpart", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__of", "__parts")
    return a.repartition(tasks, "__a", "__apart"), b.repartition(tasks, "__b", "__bpart")


def level_step(level: Column, top: float) -> Column:
    return F.lit(top) / F.pow(F.lit(2.0), level)


def farthest_km(lat: Column, lon: Column, step: Column) -> Column:
    """No point of the row's own cell is farther away."""
    cell = own_cell(lat, lon, step)
    low, width = cell["band"] * step, F.lit(360.0) / band_cells(cell["band"], step)
    up = F.radians(F.greatest(lat - low, low + step - lat))
    along = F.radians(F.least(F.lit(180.0), F.greatest(lon + 180.0 - cell["x"] * width, (cell["x"] + 1) * width - lon - 180.0)))
    wide = F.cos(F.radians(F.when((low <= 0) & (low + step >= 0), 0.0).otherwise(F.least(F.abs(low), F.abs(low + step)))))
    h = F.pow(F.sin(up / 2), 2) + F.cos(F.radians(lat)) * wide * F.pow(F.sin(along / 2), 2)
    return F.asin(F.least(F.lit(1.0), F.sqrt(h))) * (2 * EARTH_KM * (1 + 1e-9)) + 1e-6


def near_rounds(left: DataFrame, right: DataFrame, k: int, left_key: str, right_key: str, max_km: float, first_km: float, left_at: tuple[str, str], right_at: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """The pairs of all left rows that have k right rows in a cell of theirs of at most `first_km`, with rank, and the left rows that have not.

    Each row takes the smallest of its cells with k right rows: its k nearest are no farther than the farthest point of that cell, so the
    circle that it searches shrinks where right rows are dense.
    """
    a, o, b, p = [F.col(c) for c in (*left_at, *right_at)]
    top = max(0.001, min(45.0, math.degrees(first_km / EARTH_KM)))
    every = F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))
    step = level_step(F.col("__level"), top)
    full = right.select(b, p, every.alias("__level")).select("__level", own_cell(b, p, step).alias("__c")).groupBy("__level", "__c").agg(F.count("*").alias("__n")).where(F.col("__n") >= k).drop("__n")
    full = settled(full, "knn-cells")
    used = sorted(r[0] for r in full.select("__level").distinct().collect())
    if not used:
        return left.limit(0).crossJoin(right.limit(0)).withColumns({"dist_km": F.lit(0.0), "rank": F.lit(0)}), left
    own = left.select(left_key, a, o, F.explode(F.array(*[F.lit(n) for n in used])).alias("__level")).select(left_key, "__level", own_cell(a, o, step).alias("__c"))
    level = own.join(full, ["__level", "__c"], "left_semi").groupBy(left_key).agg(F.max("__level").alias("__level"))
    rows = settled(left.join(level, left_key, "left").withColumn("__km", F.least(F.lit(max_km), farthest_km(a, o, step))), "knn-levels")
    # cells of twice the step: fewer copies of a left row, as its circle is about one step wide
    wide = step * 2
    parts = int(right.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    searched = rows.where("__level is not null").repartition(parts, left_key).withColumn("__touched", F.explode(touched_cells(a, o, F.col("__km"), wide)))
    used = sorted(r[0] for r in rows.where("__level is not null").select("__level").distinct().collect())
    held = right.withColumn("__of", F.explode(F.array(*[F.lit(n) for n in used]).cast("array<int>")))
    held = held.withColumn("__cell", own_cell(b, p, level_step(F.col("__of"), top) * 2))
    pairs = searched.join(held, (F.col("__level") == F.col("__of")) & (F.col("__cell.band") == F.col("__touched.band")) & (F.col("__cell.x") == F.col("__touched.x")))
    pairs = pairs.withColumn("dist_km", haversine_km(a, o, b, p)).where(F.col("dist_km") <= F.col("__km"))
    order = Window.partitionBy(left_key).orderBy("dist_km", right_key)
    found = pairs.drop("__touched", "__cell", "__of", "__level", "__km").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found, rows.where("__level is null").drop("__level", "__km")


def knn_join(left: DataFrame, right: DataFrame, k: int, left_key: str, right_key: str, max_km: float = HALF_ROUND, first_km: float = 100.0, **at) -> DataFrame:
    """The k nearest right rows of every left row, within `max_km`, with rank from 1; ties go to the smaller right key.

    Rows with k neighbours in one of their cells of `first_km` or less search a circle that suits the density there (`near_rounds`). The
    others take rounds of radius joins: rows that found fewer than k neighbours go on with four times the radius. Each round's pairs are
    written, so no later round computes them again, and the rounds end when no row is left. No row meets all others unless the radius
    spans the sphere; rows that are left for that, if they are few, meet the other side in one pass, broadcast, without cells.
    """
    left_at, right_at = at.get("left_at", ("lat", "lon")), at.get("right_at", ("rlat", "rlon"))
    km = min(first_km, max_km)
    left, right = left.dropna(subset=list(left_at)), right.dropna(subset=list(right_at))
    out, rest = near_rounds(left, right, k, left_key, right_key, max_km, km, left_at, right_at)
    order = Window.partitionBy(left_key).orderBy("dist_km", right_key)
    while True:
        if rest.isEmpty():
            return out
        if km >= HALF_ROUND and rest.limit(SMALL + 1).count() <= SMALL:
            names = [F.col(c) for c in (*left_at, *right_at)]
            pairs = right.join(F.broadcast(rest), haversine_km(*names) <= max_km).withColumn("dist_km", haversine_km(*names))
        else:
            pairs = radius_join(rest, right, km, **at)
        found = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if km >= max_km:
            return out.unionByName(found)
        found = settled(found, "knn-round")
        enough = found.groupBy(left_key).agg(F.count("*").alias("__n")).where(F.col("__n") >= k).select(left_key)
        kept = found.join(enough, left_key, "left_semi")
        out = out.unionByName(kept)
        rest = settled(rest.join(enough, left_key, "left_anti"), "knn-rest")
        km = min(max_km, km * 4)
        if km >= HALF_ROUND / 4:
            km = max_km


def adjacency(sites: DataFrame, key: str, km: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Both directions of every pair of sites nearer than `km`: site, neighbour, dist_km."""
    a = sites.select(F.col(key).alias("site"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    b = sites.select(F.col(key).alias("neighbour"), F.col(lat).alias("rlat"), F.col(lon).alias("rlon"))
    return radius_join(a, b, km).where((F.col("site") != F.col("neighbour")) & (F.col("dist_km") < km)).select("site", "neighbour", "dist_km")


def box_join(left: DataFrame, right: DataFrame, step: float = 1.0) -> DataFrame:
    """Pairs whose boxes touch: min_x.. of the left, rmin_x.. of the right. Each pair once: it is kept in the cell of the corner where
    the common box begins."""

    def cells(p: str) -> Column:
        at = lambda c: F.floor(F.col(f"{p}{c}") / step).cast("int")
        return F.flatten(F.transform(F.sequence(at("min_x"), at("max_x")), lambda x: F.transform(F.sequence(at("min_y"), at("max_y")), lambda y: F.struct(x.alias("x"), y.alias("y")))))

    a, b = left.withColumn("__a", F.explode(cells(""))), right.withColumn("__b", F.explode(cells("r")))
    pairs = a.join(b, (F.col("__a.x") == F.col("__b.x")) & (F.col("__a.y") == F.col("__b.y")))
    touch = (F.col("min_x") <= F.col("rmax_x")) & (F.col("rmin_x") <= F.col("max_x")) & (F.col("min_y") <= F.col("rmax_y")) & (F.col("rmin_y") <= F.col("max_y"))
    corner = (F.floor(F.greatest("min_x", "rmin_x") / step) == F.col("__a.x")) & (F.floor(F.greatest("min_y", "rmin_y") / step) == F.col("__a.y"))
    return pairs.where(touch & corner).drop("__a", "__b")
