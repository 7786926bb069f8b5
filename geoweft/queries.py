"""Queries over the driver's tables, one for each operator, with the same in SQL.

The tables have no coordinates: these are derived from keys by integer arithmetic, alike in both engines. Computed doubles are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cells, geodesy, globs, projections, rings, tiles, values
from .operators import aggregates, catalog, fences, graph, joins, raster, search, store, tracks
from .plans import commands, where
from .plans import points as texts
from .shared import shared_dir
from .shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoints(spark: SparkSession) -> None:
    """Let checkpoint() write to the cluster's shared folder."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def coordinate(key: str, step: int, size: int, low: float) -> Column:
    return (F.col(key).cast("long") * step % size) / F.lit(1000.0) + low


def r6(c) -> Column:
    return F.round(c if isinstance(c, Column) else F.col(c), 6)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("collection"), coordinate("c_custkey", 7919, 180001, -90.0).alias("lat"), coordinate("c_custkey", 104729, 360001, -180.0).alias("lon"),
        F.col("c_custkey").alias("ts"), F.col("c_acctbal").alias("bal"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("site"), coordinate("s_suppkey", 15331, 180001, -90.0).alias("rlat"), coordinate("s_suppkey", 70001, 360001, -180.0).alias("rlon"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("id"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("ts"), F.col("event_id").alias("seq"),
        (F.lit(40.0) + (F.col("event_id") * 37 % 2001 - 1000) / F.lit(1000.0)).alias("lat"), (F.lit(-100.0) + (F.col("event_id") * 53 % 2001 - 1000) / F.lit(1000.0)).alias("lon"),
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = load(spark, sf_dir, "nation"), F.col("n_nationkey").cast("long")
    return n.select(F.col("n_name").alias("hook"), (F.lit(40.0) + (k * 397 % 2001 - 1000) / F.lit(1000.0)).alias("flat"), (F.lit(-100.0) + (k * 811 % 2001 - 1000) / F.lit(1000.0)).alias("flon"), (k + 20).cast("double").alias("fkm"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as objects of the key fleet, with number and string fields."""
    p = points(spark, sf_dir)
    number = lambda c: values.made(values.NUMBER, F.col(c).cast("double"), F.col(c).cast("string"))
    text = lambda c: values.made(values.STRING, 0.0, F.col(c))
    fields = F.create_map(F.lit("bal"), number("bal"), F.lit("nation"), number("nation"), F.lit("segment"), text("collection"))
    return p.select(F.lit("fleet").alias("key"), F.col("name").alias("id"), "lat", "lon", F.lit(0.0).alias("z"), F.lit(None).cast("string").alias("value"), values.without_zeros(fields).alias("fields"), F.lit(None).cast("binary").alias("geom"), F.when(F.col("ts") % 3 == 0, F.col("ts") * 1000).otherwise(0).cast("long").alias("expires"))


PTS = """pts AS (SELECT c_custkey AS id, c_mktsegment AS collection, ((c_custkey * 7919) % 180001) / 1000.0::DOUBLE - 90 AS lat,
 ((c_custkey * 104729) % 360001) / 1000.0::DOUBLE - 180 AS lon, c_custkey AS ts, c_acctbal AS bal, c_nationkey AS nation, c_name AS name FROM customer)"""
SITES = """sites AS (SELECT s_suppkey AS site, ((s_suppkey * 15331) % 180001) / 1000.0::DOUBLE - 90 AS rlat, ((s_suppkey * 70001) % 360001) / 1000.0::DOUBLE - 180 AS rlon FROM supplier)"""
POS = """pos AS (SELECT user_id AS id, epoch_us(ts) // 1000 AS ts, event_id AS seq, 40.0::DOUBLE + ((event_id * 37) % 2001 - 1000) / 1000.0::DOUBLE AS lat,
 (-100.0)::DOUBLE + ((event_id * 53) % 2001 - 1000) / 1000.0::DOUBLE AS lon FROM events)"""
ZONES = """zones AS (SELECT n_name AS hook, 40.0::DOUBLE + ((n_nationkey * 397) % 2001 - 1000) / 1000.0::DOUBLE AS flat,
 (-100.0)::DOUBLE + ((n_nationkey * 811) % 2001 - 1000) / 1000.0::DOUBLE AS flon, (n_nationkey + 20)::DOUBLE AS fkm FROM nation)"""
CHANGES = "changes AS (SELECT *, lag(lat) OVER w AS last_lat, lag(lon) OVER w AS last_lon, lag(ts) OVER w AS last_ts FROM pos WINDOW w AS (PARTITION BY id ORDER BY ts, seq))"


def hav(a: str, o: str, b: str, p: str, radius: str = "6371.0") -> str:
    h = f"(power(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * power(sin(radians({p} - {o}) / 2), 2))"
    return f"({radius} * 2 * atan2(sqrt({h}), sqrt(greatest(0.0, 1 - {h}))))"


def turn_sql(a: str, o: str, b: str, p: str) -> str:
    d = f"radians({p} - {o})"
    raw = f"degrees(atan2(sin({d}) * cos(radians({b})), cos(radians({a})) * sin(radians({b})) - sin(radians({a})) * cos(radians({b})) * cos({d})))"
    return f"(({raw} + 360.0) % 360.0)"


@query(f"WITH {PTS} SELECT id, round({hav('lat', 'lon', '30.0', '20.0')}, 6) AS dist_km FROM pts WHERE {hav('lat', 'lon', '30.0', '20.0')} <= 2000")
def radius_search(spark, d):
    return search.radius_search(points(spark, d), 30.0, 20.0, 2000.0).select("id", r6("dist_km").alias("dist_km"))


@query(f"WITH {PTS} SELECT id, collection, ts FROM pts WHERE lat BETWEEN -20 AND 45 AND (lon >= 150 OR lon <= -160)")
def bbox_search(spark, d):
    return search.box_search(points(spark, d), -20.0, 150.0, 45.0, 200.0, order="asc").select("id", "collection", "ts")


@query(f"WITH {PTS} SELECT id, round({hav('lat', 'lon', '48.0', '11.0')}, 6) AS dist_km FROM pts ORDER BY 2, 1 LIMIT 25")
def knn_topk(spark, d):
    return search.nearest(points(spark, d), 48.0, 11.0, 25).select("id", r6("dist_km").alias("dist_km"))


@query(f"WITH {PTS} SELECT id, collection, round({hav('lat', 'lon', '0.0', '0.0')}, 6) AS dist_km FROM pts WHERE collection IN ('BUILDING', 'MACHINERY') ORDER BY 3, 1 LIMIT 20")
def knn_multi_collection(spark, d):
    return search.nearest(points(spark, d), 0.0, 0.0, 20, collections=["BUILDING", "MACHINERY"]).select("id", "collection", r6("dist_km").alias("dist_km"))


@query(f"""WITH {PTS}, {SITES} SELECT site, id, dist_km, "rank" FROM (SELECT site, id, round({hav('lat', 'lon', 'rlat', 'rlon')}, 6) AS dist_km,
 CAST(row_number() OVER (PARTITION BY site ORDER BY {hav('lat', 'lon', 'rlat', 'rlon')}, id) AS INTEGER) AS "rank" FROM pts, sites) WHERE "rank" <= 3""")
def knn_join(spark, d):
    found = joins.knn_join(sites(spark, d), points(spark, d).select("id", "lat", "lon"), 3, "site", "id", first_km=800.0, left_at=("rlat", "rlon"), right_at=("lat", "lon"))
    return found.select("site", "id", r6("dist_km").alias("dist_km"), "rank")


@query(f"WITH {PTS}, {SITES} SELECT id, site, round({hav('lat', 'lon', 'rlat', 'rlon')}, 6) AS dist_km FROM pts, sites WHERE {hav('lat', 'lon', 'rlat', 'rlon')} <= 600")
def cell_join_within_km(spark, d):
    return joins.radius_join(points(spark, d), sites(spark, d), 600.0).select("id", "site", r6("dist_km").alias("dist_km"))


@query(f"""WITH {PTS}, {SITES} SELECT id, site, dist_km FROM (SELECT id, site, round({hav('lat', 'lon', 'rlat', 'rlon')}, 6) AS dist_km,
 row_number() OVER (PARTITION BY id ORDER BY {hav('lat', 'lon', 'rlat', 'rlon')}, site) AS n FROM pts, sites) WHERE n = 1""")
def nearest_site(spark, d):
    found = joins.knn_join(points(spark, d).select("id", "lat", "lon"), sites(spark, d), 1, "id", "site", first_km=1500.0)
    return found.select("id", "site", r6("dist_km").alias("dist_km"))


@query(f"WITH {SITES} SELECT a.site AS site, b.site AS neighbour, round({hav('a.rlat', 'a.rlon', 'b.rlat', 'b.rlon')}, 6) AS dist_km FROM sites a, sites b WHERE a.site <> b.site AND {hav('a.rlat', 'a.rlon', 'b.rlat', 'b.rlon')} < 1500")
def site_adjacency(spark, d):
    return joins.adjacency(sites(spark, d), "site", 1500.0, "rlat", "rlon").select("site", "neighbour", r6("dist_km").alias("dist_km"))


def geohash_sql(lat: str, lon: str, precision: int) -> str:
    bits = 5 * precision
    nlon, nlat = (bits + 1) // 2, bits // 2
    x = f"least({(1 << nlon) - 1}, floor(({lon} + 180) / 360 * {1 << nlon})::BIGINT)"
    y = f"least({(1 << nlat) - 1}, floor(({lat} + 90) / 180 * {1 << nlat})::BIGINT)"
    chars = []
    for c in range(precision):
        bit = [f"((({x} >> {nlon - 1 - b // 2}) & 1) << {4 - j})" if b % 2 == 0 else f"((({y} >> {nlat - 1 - b // 2}) & 1) << {4 - j})" for j, b in enumerate(range(5 * c, 5 * c + 5))]
        chars.append(f"substr('{cells.BASE32}', CAST(1 + {' + '.join(bit)} AS BIGINT), 1)")
    return " || ".join(chars)


@query(f"WITH {PTS} SELECT id, {geohash_sql('lat', 'lon', 5)} AS hash FROM pts")
def geohash_encode_p5(spark, d):
    return points(spark, d).select("id", cells.geohash("lat", "lon", 5).alias("hash"))


@query(f"WITH {PTS} SELECT {geohash_sql('lat', 'lon', 2)} AS cell, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM pts GROUP BY 1")
def geohash_group(spark, d):
    return aggregates.by_geohash(points(spark, d), 2).select("cell", "n", r6("lat").alias("lat"), r6("lon").alias("lon"))


@query(f"""WITH {PTS} SELECT id, round(floor((lon + 180) / 360 * 8192) * 360 / 8192 - 180, 6) AS min_lon, round(floor((lat + 90) / 180 * 4096) * 180 / 4096 - 90, 6) AS min_lat,
 {geohash_sql('lat', 'lon', 4)} AS parent FROM pts""")
def geohash_decode(spark, d):
    p = points(spark, d).withColumn("h", cells.geohash("lat", "lon", 5)).withColumn("b", cells.geohash_box("h"))
    return p.select("id", r6("b.min_lon").alias("min_lon"), r6("b.min_lat").alias("min_lat"), cells.geohash_parent("h").alias("parent"))


STEP = cells.grid_step(500.0)


@query(f"""WITH {PTS} SELECT CAST(floor(lat / {STEP!r}) AS BIGINT) || ':' || CAST(floor(lon / {STEP!r}) AS BIGINT) AS cell, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon,
 round(floor(min(lat) / {STEP!r}) * {STEP!r}, 6) AS min_lat FROM pts GROUP BY 1""")
def grid_group(spark, d):
    return aggregates.by_grid(points(spark, d), 500.0).select("cell", "n", r6("lat").alias("lat"), r6("lon").alias("lon"), r6("box.min_lat").alias("min_lat"))


@query(f"""WITH {PTS}, s AS (SELECT collection, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon, stddev_pop(lat) AS std_lat, stddev_pop(lon) AS std_lon, min(lat) AS a, min(lon) AS o, max(lat) AS b, max(lon) AS p FROM pts GROUP BY 1)
 SELECT collection, n, round(lat, 6) AS lat, round(lon, 6) AS lon, round(std_lat, 6) AS std_lat, round(std_lon, 6) AS std_lon, round({hav('a', 'o', 'b', 'p')}, 6) AS spread_km FROM s""")
def spatial_stats(spark, d):
    s = aggregates.statistics(points(spark, d), "collection")
    return s.select("collection", "n", *[r6(c).alias(c) for c in ("lat", "lon", "std_lat", "std_lon", "spread_km")])


@query(f"WITH {PTS} SELECT collection, count(*) AS n FROM pts GROUP BY 1")
def count_by_collection(spark, d):
    return aggregates.statistics(points(spark, d), "collection").select("collection", "n")


@query(f"WITH {PTS} SELECT collection, min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon FROM pts GROUP BY 1")
def collection_bounds(spark, d):
    return aggregates.extent(points(spark, d), "collection")


def pixel_sql(level: int) -> tuple[str, str]:
    size = 256 << level
    a = f"greatest(-{tiles.MAX_LAT}, least({tiles.MAX_LAT}, lat))"
    s = f"sin(radians({a}))"
    y = f"(0.5 - ln((1 + {s}) / (1 - {s})) / (4 * pi()))"
    inside = lambda v: f"CAST(trunc(greatest(0.0, least({size - 1}.0, {v} * {size}.0 + 0.5))) AS BIGINT)"
    return inside("((lon + 180.0) / 360.0)"), inside(y)


@query(f"WITH {PTS} SELECT id, {pixel_sql(10)[0]} >> 8 AS x, {pixel_sql(10)[1]} >> 8 AS y FROM pts")
def tile_xy_z10(spark, d):
    x, y = tiles.tile("lat", "lon", 10)
    return points(spark, d).select("id", x.alias("x"), y.alias("y"))


@query(f"WITH {PTS}, t AS (SELECT id, {pixel_sql(8)[0]} >> 8 AS x, {pixel_sql(8)[1]} >> 8 AS y FROM pts) SELECT id, " + " || ".join(f"CAST(((x >> {i}) & 1) + 2 * ((y >> {i}) & 1) AS VARCHAR)" for i in range(7, -1, -1)) + " AS quadkey, x, y FROM t")
def quadkey(spark, d):
    x, y = tiles.tile("lat", "lon", 8)
    p = points(spark, d).select("id", tiles.quadkey(x, y, 8).alias("quadkey")).withColumn("t", tiles.quadkey_tile("quadkey"))
    return p.select("id", "quadkey", "t.x", "t.y")


@query(f"WITH {PTS} SELECT id, least(4095, greatest(0, floor((lon + 180) / 360 * 4096)))::BIGINT AS x, least(4095, greatest(0, floor((1 - ln(tan(radians(a)) + 1 / cos(radians(a))) / pi()) / 2 * 4096)))::BIGINT AS y FROM (SELECT *, greatest(-{tiles.MAX_LAT}, least({tiles.MAX_LAT}, lat)) AS a FROM pts)")
def slippy_tile(spark, d):
    x, y = tiles.slippy("lat", "lon", 12)
    return points(spark, d).select("id", x.alias("x"), y.alias("y"))


@query(f"WITH {PTS} SELECT id, round(radians(lon) * 6378137.0, 3) AS x, round(ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137.0, 3) AS y FROM pts WHERE abs(lat) < 85")
def mercator(spark, d):
    x, y = tiles.mercator("lat", "lon")
    return points(spark, d).where("abs(lat) < 85").select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def hilbert_sql(order: int) -> str:
    n = 1 << order
    sql = f"SELECT id, least({n - 1}, floor((lon + 180.0) / 360.0 * {n})::BIGINT) AS x, least({n - 1}, floor((lat + 90.0) / 180.0 * {n})::BIGINT) AS y, 0::BIGINT AS d FROM pts"
    for i in range(order - 1, -1, -1):
        s = 1 << i
        bits = f"SELECT *, CASE WHEN x & {s} > 0 THEN 1 ELSE 0 END AS rx, CASE WHEN y & {s} > 0 THEN 1 ELSE 0 END AS ry FROM ({sql})"
        x, y = f"CASE WHEN ry = 0 AND rx = 1 THEN {s - 1} - x ELSE x END", f"CASE WHEN ry = 0 AND rx = 1 THEN {s - 1} - y ELSE y END"
        sql = f"SELECT id, CASE WHEN ry = 0 THEN {y} ELSE {x} END AS x, CASE WHEN ry = 0 THEN {x} ELSE {y} END AS y, d + {s * s} * xor(3 * rx, ry) AS d FROM ({bits})"
    return f"WITH {PTS} SELECT id, d::BIGINT AS code FROM ({sql})"


@query(hilbert_sql(10))
def hilbert_code(spark, d):
    return points(spark, d).select("id", cells.hilbert("lat", "lon", 10).alias("code"))


@query(f"""WITH {PTS}, v AS (SELECT id, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM pts),
 f AS (SELECT *, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN (CASE WHEN x >= 0 THEN 0 ELSE 3 END) WHEN abs(y) >= abs(z) THEN (CASE WHEN y >= 0 THEN 1 ELSE 4 END) ELSE (CASE WHEN z >= 0 THEN 2 ELSE 5 END) END AS f FROM v),
 uv AS (SELECT *, CASE f WHEN 0 THEN y / x WHEN 1 THEN -x / y WHEN 2 THEN -x / z WHEN 3 THEN z / x WHEN 4 THEN z / y ELSE -y / z END AS u, CASE f WHEN 0 THEN z / x WHEN 1 THEN z / y WHEN 2 THEN -y / z WHEN 3 THEN y / x WHEN 4 THEN -x / y ELSE -x / z END AS w FROM f)
 SELECT id, ((f::BIGINT << 25) | (least(4095, floor((u + 1) / 2 * 4096))::BIGINT << 13) | least(4095, floor((w + 1) / 2 * 4096))::BIGINT | 1)::BIGINT AS cell FROM uv""")
def s2like_cell(spark, d):
    return points(spark, d).select("id", cells.face_cell("lat", "lon", 12).alias("cell"))


RING = [(-40.0, -120.0), (60.0, -100.0), (20.0, 10.0), (70.0, 90.0), (-50.0, 130.0), (-10.0, 20.0)]


def pip_sql(ring: list[tuple[float, float]]) -> str:
    out = []
    for (a1, o1), (a2, o2) in zip(ring, ring[1:] + ring[:1], strict=True):
        out.append(f"CASE WHEN ({o1} > lon) <> ({o2} > lon) AND lat < ({a2} - {a1}) * (lon - {o1}) / ({o2} - ({o1})) + {a1} THEN 1 ELSE 0 END")
    return f"({' + '.join(out)}) % 2 = 1"


@query(f"WITH {PTS} SELECT id, lat, lon FROM pts WHERE {pip_sql(RING)}")
def pip_polygon(spark, d):
    return points(spark, d).where(rings.contains(rings.ring(RING), "lat", "lon")).select("id", "lat", "lon")


@query(f"""WITH {PTS}, p AS (SELECT *, radians(lat) AS a, radians(lon) AS o, radians({turn_sql('lat', 'lon', '10.0', '20.0')}) AS b, 250.0 / 6371.0 AS d FROM pts), q AS (SELECT *, asin(sin(a) * cos(d) + cos(a) * sin(d) * cos(b)) AS t FROM p)
 SELECT id, round(degrees(b), 6) AS bearing, round(degrees(t), 6) AS lat2, round(degrees(o + atan2(sin(b) * sin(d) * cos(a), cos(d) - sin(a) * sin(t))), 6) AS lon2 FROM q""")
def bearing_destination(spark, d):
    p = points(spark, d).withColumn("b", geodesy.heading("lat", "lon", 10.0, 20.0))
    lat, lon = geodesy.destination("lat", "lon", "b", 250.0)
    return p.select("id", r6("b").alias("bearing"), r6(lat).alias("lat2"), r6(lon).alias("lon2"))


STEPS = f"""{POS}, {CHANGES}, steps AS (SELECT *, CASE WHEN last_ts IS NULL THEN 0.0 ELSE {hav('last_lat', 'last_lon', 'lat', 'lon')} END AS km, greatest(coalesce(ts - last_ts, 0), 0) AS dt,
 CASE WHEN last_ts IS NULL THEN 0.0 ELSE {turn_sql('last_lat', 'last_lon', 'lat', 'lon')} END AS heading FROM changes), moved AS (SELECT *, CASE WHEN dt > 0 THEN km / (dt / 3600000.0::DOUBLE) ELSE 0.0 END AS speed FROM steps)"""


@query(f"WITH {STEPS} SELECT seq, id, round(km, 6) AS km, round(speed, 3) AS speed_kmh, round(heading, 5) AS heading FROM moved")
def trajectory_steps(spark, d):
    return tracks.steps(positions(spark, d)).select("seq", "id", r6("km").alias("km"), F.round("speed_kmh", 3).alias("speed_kmh"), F.round("heading", 5).alias("heading"))


@query(f"""WITH {STEPS}, s AS (SELECT id, count(*) AS n, sum(km) AS km, max(speed) AS mx, max(ts) - min(ts) AS duration_ms FROM moved GROUP BY id)
 SELECT id, n, round(km, 5) AS km, round(mx, 5) AS max_speed, duration_ms, round(CASE WHEN duration_ms > 0 THEN km / (duration_ms / 3600000.0::DOUBLE) ELSE 0.0 END, 5) AS avg_speed FROM s""")
def trajectory_stats(spark, d):
    s = tracks.statistics(positions(spark, d))
    return s.select("id", "n", F.round("km", 5).alias("km"), F.round("max_speed", 5).alias("max_speed"), "duration_ms", F.round("avg_speed", 5).alias("avg_speed"))


@query(f"WITH {POS} SELECT id, seq, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) AS nth FROM pos) WHERE nth <= 5")
def last_n_points(spark, d):
    return search.last_points(positions(spark, d), 5).select("id", "seq", "nth")


@query(f"""WITH {STEPS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) AS nth FROM moved) WHERE nth = 1), p AS (SELECT *, radians(lat) AS a, radians(heading) AS b, speed * (600000 / 3600000.0::DOUBLE) / 6371.0 AS d FROM l),
 q AS (SELECT *, asin(sin(a) * cos(d) + cos(a) * sin(d) * cos(b)) AS t FROM p) SELECT id, round(CASE WHEN speed > 0 THEN degrees(t) ELSE lat END, 5) AS lat, round(CASE WHEN speed > 0 THEN degrees(radians(lon) + atan2(sin(b) * sin(d) * cos(a), cos(d) - sin(a) * sin(t))) ELSE lon END, 5) AS lon FROM q""")
def predict_position(spark, d):
    return tracks.predicted(positions(spark, d), 600000).select("id", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


DETECTED = f"""{POS}, {CHANGES}, {ZONES}, pairs AS (SELECT *, {hav('lat', 'lon', 'flat', 'flon')} <= fkm AS now, coalesce({hav('last_lat', 'last_lon', 'flat', 'flon')} <= fkm, false) AS was,
 CASE WHEN (lat - last_lat) = 0 AND (lon - last_lon) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, ((flat - last_lat) * (lat - last_lat) + (flon - last_lon) * (lon - last_lon)) / ((lat - last_lat) * (lat - last_lat) + (lon - last_lon) * (lon - last_lon)))) END AS t FROM changes, zones),
 detected AS (SELECT *, CASE WHEN was AND now THEN 'inside' WHEN was THEN 'exit' WHEN now THEN 'enter' WHEN last_lat IS NOT NULL AND {hav('flat', 'flon', '(last_lat + t * (lat - last_lat))', '(last_lon + t * (lon - last_lon))')} <= fkm THEN 'cross' ELSE 'outside' END AS detect FROM pairs)"""


@query(f"WITH {DETECTED} SELECT seq, hook, detect FROM detected WHERE was OR now")
def fence_transitions(spark, d):
    return fences.touched(fences.with_last(positions(spark, d)), zones(spark, d))


@query(f"""WITH {DETECTED}, said AS (SELECT seq, hook, detect AS message FROM detected UNION ALL SELECT seq, hook, 'inside' FROM detected WHERE detect = 'enter' UNION ALL SELECT seq, hook, 'outside' FROM detected WHERE detect IN ('exit', 'cross'))
 SELECT message, hook, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM said WHERE message IN ('enter', 'exit', 'cross', 'inside') GROUP BY ALL""")
def fence_events_detect(spark, d):
    rows = fences.messages(fences.passed(fences.with_last(positions(spark, d)), zones(spark, d)), ["enter", "exit", "cross", "inside"])
    return rows.groupBy("message", "hook").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query(f"WITH {DETECTED} SELECT seq, hook, CASE WHEN detect = 'inside' THEN 'cross' ELSE detect END AS detect FROM detected WHERE detect IN ('enter', 'exit', 'inside')")
def fence_stay_rule(spark, d):
    return fences.stay_in(fences.touched(fences.with_last(positions(spark, d)), zones(spark, d)))


@query(f"WITH {DETECTED}, t AS (SELECT * FROM detected WHERE was OR now) SELECT seq, hook, CAST(sum(CASE WHEN detect IN ('enter', 'cross') THEN 1 ELSE 0 END) OVER (PARTITION BY hook, id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS visit FROM t")
def fence_groups(spark, d):
    changes = fences.with_last(positions(spark, d))
    found = fences.touched(changes, zones(spark, d)).join(changes.select("seq", "id"), "seq")
    return fences.groups(found).select("seq", "hook", "visit")


@query(f"""WITH {POS}, {CHANGES}, {ZONES}, pairs AS (SELECT seq, hook, {hav('lat', 'lon', 'flat', 'flon')} AS km, {hav('lat', 'lon', 'flat', 'flon')} <= 15 AS now, coalesce({hav('last_lat', 'last_lon', 'flat', 'flon')} <= 15, false) AS was FROM changes, zones)
 SELECT seq, hook, CASE WHEN now THEN 'nearby' ELSE 'faraway' END AS kind, round(km, 3) AS km FROM pairs WHERE now <> was""")
def roam_nearby_faraway(spark, d):
    others = zones(spark, d).select(F.col("hook").alias("oid"), F.col("flat").alias("olat"), F.col("flon").alias("olon"))
    changes = fences.with_last(positions(spark, d)).withColumn("id", F.col("id").cast("string"))
    rows = fences.roaming(changes, others, 15000.0, nodwell=True)
    return rows.join(changes.select("seq", "lat", "lon"), "seq").join(others, "oid").select("seq", F.col("oid").alias("hook"), "kind", F.round(geodesy.haversine_km("lat", "lon", "olat", "olon"), 3).alias("km"))


@query(f"WITH {PTS}, p AS (SELECT name, nation FROM pts ORDER BY name LIMIT 1000000 OFFSET 30) SELECT name AS id FROM p WHERE nation BETWEEN 5 AND 15 ORDER BY name LIMIT 40")
def scan_page(spark, d):
    return commands.Engine(objects(spark, d)).run("SCAN fleet CURSOR 30 LIMIT 40 WHERE nation 5 15 IDS")


@query("SELECT p_name AS id, p_type AS value FROM part WHERE p_type LIKE 'STANDARD%' ORDER BY p_type, p_partkey")
def search_values_range(spark, d):
    p = load(spark, d, "part")
    empty = F.create_map().cast(f"map<string, {values.VALUE}>").alias("fields")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    texts_ = p.select(F.lit("parts").alias("key"), F.col("p_name").alias("id"), none("lat", "double"), none("lon", "double"), F.lit(0.0).alias("z"), F.col("p_type").alias("value"), empty, none("geom", "binary"), F.lit(0).cast("long").alias("expires"))
    return commands.Engine(texts_).run("SEARCH parts LIMIT 1000000000000 MATCH STANDARD* NOFIELDS OBJECTS").select("id", "value")


@query("SELECT c_name AS id FROM customer WHERE regexp_matches(c_name, '^Customer#0000000[1-3].[02468]$') OR c_name LIKE '%77'")
def match_glob(spark, d):
    return load(spark, d, "customer").where(globs.matches(F.col("c_name"), ["Customer#0000000[1-3]?[02468]", "*77"])).select(F.col("c_name").alias("id"))


@query(f"WITH {PTS} SELECT name AS id FROM pts WHERE bal > 1000 AND bal <= 5000.5 AND nation >= 3")
def where_range(spark, d):
    return commands.Engine(objects(spark, d)).run("SCAN fleet LIMIT 1000000000000 WHERE bal (1000 5000.5 WHERE nation >= 3 IDS")


@query(f"WITH {PTS} SELECT count(*) AS count FROM pts WHERE nation IN (0, 3, 7) AND lower(collection) IN ('building', 'furniture')")
def where_in(spark, d):
    return commands.Engine(objects(spark, d)).run("SCAN fleet WHEREIN nation 3 0 3 7 WHEREIN segment 2 Building FURNITURE COUNT")


@query("SELECT event_id FROM events WHERE CAST(props->>'k' AS DOUBLE) * 2 + value > 150 AND event_type IN ('view', 'click') OR regexp_matches(event_type, '^sig') AND NOT CAST(props->>'k' AS DOUBLE) % 3 == 1")
def where_expr_json(spark, d):
    e = load(spark, d, "events")
    fields = F.create_map(F.lit("value"), values.made(values.NUMBER, F.col("value"), F.col("value").cast("string")), F.lit("kind"), values.made(values.STRING, 0.0, F.col("event_type")))
    rows = e.select("event_id", F.col("props").alias("doc"), fields.alias("fields"))
    test = where.parse("k * 2 + value > 150 && (kind == 'view' || kind == 'CLICK') || kind =~ '^sig' && !(k % 3 == 1)", where.Names(id="event_id", properties="doc"))
    return rows.where(test).select("event_id")


@query(f"WITH {PTS} SELECT name AS id, CASE WHEN nation = 0 THEN '0' ELSE CAST(nation AS VARCHAR) END AS nation, '0' AS missing FROM pts")
def missing_field_zero(spark, d):
    return objects(spark, d).select("id", values.field("nation")["data"].alias("nation"), values.field("nothing")["data"].alias("missing"))


@query("""SELECT event_id, CAST(kind AS INTEGER) AS kind, num, txt FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 1 ELSE 0 END AS kind,
 CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 97 AS DOUBLE) ELSE 0.0 END AS num, CASE WHEN event_id % 5 = 1 THEN lower(event_type) ELSE '' END AS txt FROM events)""")
def value_order_sort(spark, d):
    text = F.expr("CASE event_id % 5 WHEN 0 THEN cast(event_id % 97 as string) WHEN 1 THEN upper(event_type) WHEN 2 THEN 'true' WHEN 3 THEN 'false' ELSE 'null' END")
    v = load(spark, d, "events").select("event_id", values.value_of(text).alias("v"))
    key = values.sort_key(F.col("v"))
    return v.select("event_id", F.col("v.kind").alias("kind"), key["col2"].alias("num"), key["col3"].alias("txt")).orderBy("kind", "num", "txt", "event_id")


@query(f"""WITH {PTS}, c AS (SELECT id, CAST(least(7, floor((lon + 180) / 360 * 8)) AS INTEGER) AS cell_x, CAST(least(7, floor((lat + 60) / 120 * 8)) AS INTEGER) AS cell_y FROM pts WHERE lat BETWEEN -60 AND 60)
 SELECT min(id) AS id, cell_x, cell_y FROM c GROUP BY cell_x, cell_y""")
def sparse_thin(spark, d):
    return search.sparse(points(spark, d), -60.0, -180.0, 60.0, 180.0, 3).select("id", "cell_x", "cell_y")


@query(f"WITH {PTS} SELECT id FROM pts WHERE (lat BETWEEN 0 AND 60 AND lon BETWEEN -50 AND 100) AND NOT ({hav('lat', 'lon', '30.0', '30.0')} <= 1500) OR ({hav('lat', 'lon', '-30.0', '140.0')} <= 2500)")
def area_expr_and_or_not(spark, d):
    from .plans import areas

    tree = areas.expression(areas.Words("BOUNDS 0 -50 60 100 AND NOT CIRCLE 30 30 1500000 OR CIRCLE -30 140 2500000".split()))
    return points(spark, d).where(tree(lambda a: a.point(F.col("lat"), F.col("lon")))).select("id")


@query(f"WITH {PTS} SELECT id FROM pts WHERE {hav('lat', 'lon', '20.0', '10.0')} <= 4000 AND ({turn_sql('20.0', '10.0', 'lat', 'lon')} >= 300 OR {turn_sql('20.0', '10.0', 'lat', 'lon')} <= 60)")
def sector_search(spark, d):
    return points(spark, d).where(geodesy.in_sector("lat", "lon", 20.0, 10.0, 4_000_000.0, 300.0, 60.0)).select("id")


@query(f"WITH {PTS} SELECT name AS id, CASE WHEN ts % 3 = 0 AND ts > 0 THEN (ts * 1000 - 400000) / 1e9::DOUBLE ELSE -1.0 END AS ttl FROM pts WHERE ts % 3 <> 0 OR ts = 0 OR ts * 1000 > 400000")
def ttl_live_rows(spark, d):
    live = commands.Engine(objects(spark, d), now_ns=400000).objects
    return live.select("id", F.when(F.col("expires") == 0, -1.0).otherwise((F.col("expires") - 400000) / 1e9).alias("ttl"))


@query("SELECT id, value FROM (SELECT user_id AS id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def set_merge_lww(spark, d):
    log = load(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "value", (F.col("event_type") == "error").alias("deleted"))
    return search.last_write(log, ["id"]).select("id", "value")


@query("SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer WHERE c_name NOT LIKE '%5' AND NOT regexp_matches(c_name, '1.3$')")
def pdel_glob(spark, d):
    c = load(spark, d, "customer").select(F.lit("c").alias("key"), F.col("c_name").alias("id"), "c_custkey")
    return store.delete(c, "c", patterns=["*5", "*1?3"]).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 200000)")
def orphans_anti_join(spark, d):
    o = load(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 200000").select("o_custkey")
    return catalog.without_dependants(load(spark, d, "customer"), "c_custkey", o, "o_custkey").select(F.col("c_custkey").alias("id"))


@query("SELECT p_partkey AS id FROM part WHERE p_brand LIKE 'Brand#2%' AND lower(p_type) LIKE '%m%'")
def tag_filter(spark, d):
    tags = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))
    p = catalog.records(load(spark, d, "part").select("p_partkey", tags.alias("tags")), tags={"brand": "Brand#2*", "type": None})
    return p.where(catalog.like(F.col("tags")["type"], "*M*", any_case=True)).select(F.col("p_partkey").alias("id"))


@query("""WITH r AS (SELECT o_custkey AS grp, o_orderkey AS idx, o_orderstatus AS s, substr(o_orderpriority, 1, 1) AS p FROM orders), t AS (SELECT grp, idx, 'status' AS k, s AS v FROM r UNION ALL SELECT grp, idx, 'priority', p FROM r),
 g AS (SELECT grp, k, count(DISTINCT v) AS vals FROM t GROUP BY 1, 2) SELECT DISTINCT t.grp AS grp, CASE WHEN vals = 1 THEN k ELSE k || '.' || idx END AS name, v FROM t JOIN g USING (grp, k)""")
def merge_tags(spark, d):
    tags = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.substring("o_orderpriority", 1, 1))
    return aggregates.merged_tags(load(spark, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("idx"), tags.alias("tags")))


@query("SELECT p_partkey AS id, round(power((p_size - 1) / 49.0::DOUBLE, 1.5) * 300 - 100, 6) AS ext, round(greatest(0.0, least(255.0, power(greatest(0.0, (p_retailprice - 900) / 1200.0), 0.5) * 255))) AS stored FROM part")
def raster_value_mapping(spark, d):
    out = raster.to_external("p_size", 1.0, 50.0, -100.0, 200.0, 1.5)
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), r6(out).alias("ext"), raster.to_internal("p_retailprice", 0.0, 255.0, 900.0, 2100.0, 2.0, "uint8").alias("stored"))


PIXELS = "px AS (SELECT l_suppkey % 50 AS row, l_partkey % 40 AS col, l_orderkey AS ds, l_linenumber AS ln, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS value FROM lineitem)"


def pixels(spark, d):
    value = F.when(F.col("l_linenumber") != 3, F.col("l_quantity"))
    return load(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("row"), (F.col("l_partkey") % 40).alias("col"), F.col("l_orderkey").alias("ds"), F.col("l_linenumber").alias("ln"), value.alias("value"))


@query(f"""WITH {PIXELS} SELECT "row", col, value FROM (SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY ds DESC, ln DESC, value DESC) AS n FROM px WHERE value IS NOT NULL) WHERE n = 1""")
def mosaic_last_valid(spark, d):
    return raster.mosaic(pixels(spark, d), ["ds", "ln", "value"])


@query(f"""WITH {PIXELS} SELECT "row" // 4 AS out_row, col // 4 AS out_col, round(avg(value), 6) AS value FROM px WHERE value IS NOT NULL GROUP BY 1, 2""")
def resample_average(spark, d):
    return raster.resampled(pixels(spark, d), 4).select("out_row", "out_col", r6("value").alias("value"))


@query(f"WITH {PIXELS} SELECT ds AS dataset, count(*) AS n, count(value) AS valid FROM px GROUP BY 1 HAVING count(value) >= count(*) * 0.9")
def enough_valid(spark, d):
    return raster.enough_valid(pixels(spark, d).withColumnRenamed("ds", "dataset"), 0.9)


@query("SELECT event_type AS type, CAST(CAST(props->>'k' AS INTEGER) % 4 AS VARCHAR) AS version, count(*) AS n FROM events GROUP BY 1, 2")
def stac_like_stats(spark, d):
    version = (F.get_json_object("props", "$.k").cast("int") % 4).cast("string")
    return load(spark, d, "events").groupBy(F.col("event_type").alias("type"), version.alias("version")).agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst, (n_nationkey % 5 + 1)::DOUBLE AS cost FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 1) % 25, 3.0 FROM nation),
 r(node, cost, hops) AS (SELECT 0, 0.0::DOUBLE, 0 UNION SELECT dst, r.cost + e.cost, hops + 1 FROM r JOIN e ON src = node WHERE hops < 8 AND r.cost + e.cost < 16) SELECT node, min(cost) AS cost FROM r GROUP BY 1""")
def shortest_path(spark, d):
    checkpoints(spark)
    n = load(spark, d, "nation")
    k = F.col("n_nationkey")
    edges = n.select(k.alias("src"), (k * 7 + 3).alias("dst"), (k % 5 + 1).cast("double").alias("cost")).withColumn("dst", F.col("dst") % 25).unionByName(n.select(k.alias("src"), ((k + 1) % 25).alias("dst"), F.lit(3.0).alias("cost")))
    return graph.costs_from(edges.withColumn("dst", F.col("dst").cast("int")), 0).select("node", "cost").where("cost < 16")


@query(f"""WITH {PTS}, k AS (SELECT unnest(['BUILDING', 'NOTHING']) AS "key") SELECT k.key AS "key", n AS num_objects FROM k LEFT JOIN (SELECT collection, count(*) AS n FROM pts GROUP BY 1) ON collection = k.key""")
def key_stats(spark, d):
    o = points(spark, d).select(F.col("collection").alias("key"), F.lit(1).alias("n_points"), F.lit(None).cast("string").alias("value"))
    keys = spark.createDataFrame([("BUILDING",), ("NOTHING",)], "key string")
    return aggregates.key_stats(o, keys).select("key", "num_objects")


@query(f"WITH {PTS} SELECT id, lat FROM pts WHERE id > 500 ORDER BY id LIMIT 60")
def keyset_page(spark, d):
    return search.keyset_page(points(spark, d), 500, 60).select("id", "lat")


@query(f"WITH {PTS} SELECT id, round((lon + 180.0 + 170.0) % 360.0 - 180.0, 6) AS lon, CAST(sign(lat) AS INTEGER) AS sign, CAST(floor(abs(lat)) AS INTEGER) AS degrees, CAST(floor((abs(lat) - floor(abs(lat))) * 60) AS INTEGER) AS minutes FROM pts")
def degrees_minutes(spark, d):
    p = points(spark, d).withColumn("x", geodesy.dms("lat"))
    return p.select("id", r6(geodesy.normal_lon(F.col("lon") + 170.0)).alias("lon"), "x.sign", "x.degrees", "x.minutes")


def ring_sql() -> str:
    area = " + ".join(f"(radians({o2} - ({o1})) * (2 + sin(radians({a1})) + sin(radians({a2}))))" for (a1, o1), (a2, o2) in zip(RING, RING[1:] + RING[:1], strict=True))
    length = " + ".join(hav(f"({a1})", f"({o1})", f"({a2})", f"({o2})") for (a1, o1), (a2, o2) in zip(RING, RING[1:] + RING[:1], strict=True))
    return f"SELECT r_regionkey AS id, round(abs({area}) * 6371.0 * 6371.0 / 2, 3) AS area_km2, round({length}, 6) AS perimeter_km FROM region"


@query(ring_sql())
def ring_measures(spark, d):
    r = rings.ring(RING)
    return load(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.round(rings.area_km2(r), 3).alias("area_km2"), r6(rings.perimeter_km(r)).alias("perimeter_km"))


@query(f"WITH {PTS}, {SITES}, b AS (SELECT id, lon AS x0, lat AS y0, lon + 3 + id % 4 AS x1, lat + 2 + id % 3 AS y1 FROM pts), c AS (SELECT site, rlon AS rx0, rlat AS ry0, rlon + 5 AS rx1, rlat + 4 AS ry1 FROM sites) SELECT id, site FROM b, c WHERE x0 <= rx1 AND rx0 <= x1 AND y0 <= ry1 AND ry0 <= y1")
def box_join(spark, d):
    a = points(spark, d).select("id", F.col("lon").alias("min_x"), F.col("lat").alias("min_y"), (F.col("lon") + 3 + F.col("id") % 4).alias("max_x"), (F.col("lat") + 2 + F.col("id") % 3).alias("max_y"))
    b = sites(spark, d).select("site", F.col("rlon").alias("rmin_x"), F.col("rlat").alias("rmin_y"), (F.col("rlon") + 5).alias("rmax_x"), (F.col("rlat") + 4).alias("rmax_y"))
    return joins.box_join(a, b, 4.0).select("id", "site")


@query(f"""WITH {PTS} SELECT id, CAST(CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lat < 84 AND lon >= 0 AND lon < 42 THEN (CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END)
 ELSE (floor((lon + 180) / 6)::INTEGER % 60) + 1 END AS INTEGER) AS zone, CASE WHEN lat BETWEEN -80 AND 84 THEN substr('CDEFGHJKLMNPQRSTUVWX', CAST(least(floor((lat + 80) / 8), 19) AS BIGINT) + 1, 1) ELSE 'Z' END AS letter FROM pts""")
def utm_zone(spark, d):
    return points(spark, d).select("id", projections.utm_zone("lat", "lon").alias("zone"), projections.utm_letter("lat").alias("letter"))


@query(f"""WITH {PTS}, k AS (SELECT ln(cos(radians(33.0)) / cos(radians(45.0))) / ln(tan(pi() / 4 + radians(45.0) / 2) / tan(pi() / 4 + radians(33.0) / 2)) AS n), g AS (SELECT n, cos(radians(33.0)) * power(tan(pi() / 4 + radians(33.0) / 2), n) / n AS f FROM k),
 r AS (SELECT id, f / power(tan(pi() / 4 + radians(lat) / 2), n) AS rho, n * radians(lon + 96.0) AS t, f / power(tan(pi() / 4 + radians(39.0) / 2), n) AS rho0 FROM pts, g WHERE lat BETWEEN 10 AND 70) SELECT id, round(rho * sin(t) * 6378137.0, 2) AS x, round((rho0 - rho * cos(t)) * 6378137.0, 2) AS y FROM r""")
def lambert_conic(spark, d):
    x, y = projections.lcc("lat", "lon", 33.0, 45.0, 39.0, -96.0)
    return points(spark, d).where("lat between 10 and 70").select("id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query(f"WITH {PTS} SELECT id, collection FROM pts WHERE collection <> 'AUTOMOBILE' AND (contains(id::VARCHAR, '7') OR starts_with(id::VARCHAR, '12'))")
def filter_text(spark, d):
    return points(spark, d).where(texts.parse_filter("collection != AUTOMOBILE AND (id ~ 7 OR id ^ 12)")).select("id", "collection")


@query(f"WITH {PTS} SELECT id, round({hav('lat', 'lon', '10.0', '20.0')}, 6) AS dist_km FROM pts WHERE collection = 'BUILDING' AND {hav('lat', 'lon', '10.0', '20.0')} <= 5000 ORDER BY 2, 1 LIMIT 12")
def nearby_text(spark, d):
    return texts.run(points(spark, d), "NEARBY BUILDING 10 20 5000 LIMIT 12").select("id", r6("dist_km").alias("dist_km"))


@query(f"WITH {PTS} SELECT id, ts FROM pts WHERE collection = 'MACHINERY' AND lat BETWEEN -30 AND 30 AND lon BETWEEN -60 AND 60")
def within_text(spark, d):
    return texts.run(points(spark, d), "WITHIN MACHINERY -30 -60 30 60", default=None).select("id", "ts")


@query(f"""WITH {PTS}, q AS (SELECT id, radians(lat) AS q, radians(lon) AS p, radians(10.0) AS s, radians(20.0) AS w, radians(30.0) AS n, radians(50.0) AS e FROM pts),
 t AS (SELECT *, CASE WHEN w - p < 0 THEN w - p + 2 * pi() ELSE w - p END AS dw, CASE WHEN p - e < 0 THEN p - e + 2 * pi() ELSE p - e END AS de FROM q), u AS (SELECT *, least(dw, de) AS d, CASE WHEN dw <= de THEN w ELSE e END AS g FROM t),
 v AS (SELECT *, 2 * asin(least(1.0, sqrt(power(sin((q - n) / 2), 2) + power(sin((p - g) / 2), 2) * cos(q) * cos(n)))) AS cn, 2 * asin(least(1.0, sqrt(power(sin((q - s) / 2), 2) + power(sin((p - g) / 2), 2) * cos(q) * cos(s)))) AS cs FROM u)
 SELECT id, round(6371000.0 * CASE WHEN w <= p AND p <= e THEN (CASE WHEN q < s THEN s - q WHEN q > n THEN q - n ELSE 0.0 END) WHEN d >= pi() / 2 THEN (CASE WHEN tan(q) >= tan((n + s) / 2) * cos(d) THEN cn ELSE cs END)
 WHEN tan(q) >= tan(n) * cos(d) THEN cn WHEN tan(q) <= tan(s) * cos(d) THEN cs ELSE asin(cos(q) * sin(d)) END, 3) AS meters FROM v""")
def rect_distance(spark, d):
    return points(spark, d).select("id", F.round(geodesy.point_rect_m("lat", "lon", 10.0, 20.0, 30.0, 50.0), 3).alias("meters"))


@query(f"WITH {PTS} SELECT CAST(CASE WHEN lat >= 0 THEN 0 ELSE 2 END + CASE WHEN lon >= 0 THEN 1 ELSE 0 END AS INTEGER) AS quadrant, count(*) AS n FROM pts GROUP BY 1")
def quadrant_counts(spark, d):
    return points(spark, d).groupBy(cells.quadrant("lat", "lon", 0.0, 0.0).cast("int").alias("quadrant")).agg(F.count("*").alias("n"))


@query(f"WITH {POS}, l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) AS n FROM pos) SELECT id, seq, lat, lon FROM l WHERE n = 1")
def last_point(spark, d):
    log = positions(spark, d).select("id", F.struct("ts", "seq").alias("at"), "seq", "lat", "lon", F.lit(False).alias("deleted"))
    return search.last_write(log, ["id"], seq="at").select("id", "seq", "lat", "lon")


@query("SELECT o_custkey AS record, CAST(count(*) AS INTEGER) AS n, CAST(arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS BIGINT) AS first FROM orders GROUP BY 1")
def datasets_by_record(spark, d):
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("record"), F.col("o_orderdate").alias("datetime"), F.col("o_orderkey").alias("dataset"))
    g = raster.datasets_by_record(o)
    return g.select("record", F.size("datasets").alias("n"), F.get("datasets", 0)["dataset"].alias("first"))


@query("SELECT p_partkey AS id, CAST(round(CASE WHEN p_size <= 10 THEN 0.0 WHEN p_size <= 30 THEN 0 + 200 * (p_size - 10.0) / 20 WHEN p_size <= 50 THEN 200 + 55 * (p_size - 30.0) / 20 ELSE 255.0 END) AS INTEGER) AS r FROM part")
def colour_map(spark, d):
    colour = raster.palette("p_size", [(10.0, 0, 0, 0), (30.0, 200, 10, 0), (50.0, 255, 255, 255)])
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), colour["r"].alias("r"))


@query(f"""WITH {PIXELS} SELECT "row" // 10 AS out_row, col // 10 AS out_col, median(value) AS value FROM px WHERE value IS NOT NULL GROUP BY 1, 2""")
def resample_median(spark, d):
    return raster.resampled(pixels(spark, d), 10, "med")


@query("""SELECT kind, k, v, count(*) AS n FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS kind, event_type AS k, props->>'k' AS v FROM events) WHERE kind = 'way' GROUP BY ALL""")
def osm_tag_counts(spark, d):
    kind = F.expr("CASE event_id % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END")
    e = load(spark, d, "events").select(kind.alias("kind"), F.create_map(F.col("event_type"), F.get_json_object("props", "$.k")).alias("tags"))
    return aggregates.tag_counts(e).where("way > 0").select(F.lit("way").alias("kind"), F.col("key").alias("k"), F.col("value").alias("v"), F.col("way").alias("n"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderpriority LIKE '1-%' AND o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1997-06-30'")
def record_filters(spark, d):
    tags = F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus"))
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("name"), F.col("o_orderdate").alias("datetime"), tags.alias("tags"))
    day = lambda s: F.lit(s).cast(o.schema["datetime"].dataType)
    return catalog.records(o, "ord*", {"priority": "1-*", "status": "O"}, day("1995-01-01 00:00:00"), day("1997-06-30 00:00:00")).select("id")


@query(f"""WITH {PTS}, a AS (SELECT id, unnest(range(floor(lon / 2)::BIGINT, floor((lon + 3) / 2)::BIGINT + 1)) AS i, lat FROM pts), b AS (SELECT id, i, unnest(range(floor(lat / 2)::BIGINT, floor((lat + 1.5) / 2)::BIGINT + 1)) AS j FROM a)
 SELECT id, i || '/' || j AS cell, CAST(i * 2 AS DOUBLE) AS x0, CAST(j * 2 + 2 AS DOUBLE) AS y1 FROM b""")
def layout_cells(spark, d):
    boxes = points(spark, d).select("id", F.col("lon").alias("min_x"), F.col("lat").alias("min_y"), (F.col("lon") + 3).alias("max_x"), (F.col("lat") + 1.5).alias("max_y"))
    return catalog.layout_cells(boxes, 2.0).select("id", "cell", "x0", "y1")


from . import queries_more as _more  # noqa: E402, F401  (registers its queries)
