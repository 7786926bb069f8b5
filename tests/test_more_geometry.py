import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweft import queries_more
from geoweft.functions import documents, overlay, projections
from geoweft.functions import geometry as geo
from geoweft.plans import points
from geoweft.sources import mvt


def blob(rng, cx, cy, n=7):
    ring = []
    for i in range(n):
        a, d = 2 * math.pi * i / n, rng.uniform(2, 5)
        ring.append([cx + d * math.cos(a), cy + d * math.sin(a)])
    return {"type": "Polygon", "coordinates": [[*ring, ring[0]]]}


def inside(p, g):
    return any(geo.polygon_position(p, poly) > 0 for poly in geo.parts(g)[2])


def test_overlay_against_points():
    rng = random.Random(11)
    tests = {"intersection": lambda a, b: a and b, "union": lambda a, b: a or b, "difference": lambda a, b: a and not b, "xor": lambda a, b: a != b}
    for _ in range(12):
        a, b = blob(rng, 0, 0), blob(rng, rng.uniform(-5, 5), rng.uniform(-5, 5))
        for op, test in tests.items():
            c = overlay.combine(a, b, op)
            for _ in range(60):
                p = [rng.uniform(-9, 9), rng.uniform(-9, 9)]
                assert inside(p, c) == test(inside(p, a), inside(p, b)), op


def test_overlay_with_shared_edges():
    a, b = geo.rectangle(0, 0, 4, 4), geo.rectangle(4, 0, 8, 4)
    assert geo.area(overlay.combine(a, b, "union")) == 32 and geo.area(overlay.combine(a, b, "intersection")) == 0
    assert geo.area(overlay.combine(a, geo.rectangle(1, 1, 2, 2), "difference")) == 15 and geo.area(overlay.combine(a, a, "intersection")) == 16


def test_union_aggregate(spark):
    rows = [(i % 2, geo.to_wkb(geo.rectangle(i, 0, i + 3, 1))) for i in range(8)]
    got = overlay.union_by(spark.createDataFrame(rows, "g int, geom binary"), "g", parts=3)
    assert {r["g"]: geo.area(geo.from_wkb(bytes(r["geom"]))) for r in got.collect()} == {0: 9, 1: 9}


def test_buffer_covers():
    g = {"type": "LineString", "coordinates": [[10, 50], [10.1, 50.05]]}
    b = overlay.buffered(g, 500)
    assert inside([10.05, 50.027], b) and not inside([10.05, 50.06], b)
    with pytest.raises(ValueError):
        overlay.buffer_point(0, 0, math.nan)


def test_delaunay_is_empty_of_points():
    rng = random.Random(2)
    pts = [[rng.uniform(0, 10), rng.uniform(0, 10)] for _ in range(40)]
    tris = overlay.delaunay(pts)
    ring = geo.hull(pts)
    assert sum(abs(geo.turn(*[pts[i] for i in t])) / 2 for t in tris) == pytest.approx(geo.ring_area(ring), rel=1e-3)
    for t in tris:
        a, b, c = (np.array(pts[i]) for i in t)
        m = np.linalg.solve(2 * np.array([b - a, c - a]), [b @ b - a @ a, c @ c - a @ a])
        assert all(math.dist(m, p) >= math.dist(m, a) - 1e-9 for p in pts)
    assert overlay.delaunay([[0, 0], [0, 0], [1, 1]]) == []


def test_utm(spark):
    df = spark.createDataFrame([(52.5, 13.4), (-33.9, 151.2), (60.0, 5.0), (78.0, 10.0), (0.0, -180.0)], "lat double, lon double").withColumn("u", projections.utm("lat", "lon"))
    rows = df.collect()
    assert [(r["u"]["zone"], r["u"]["letter"]) for r in rows] == [(33, "U"), (56, "H"), (32, "V"), (33, "X"), (1, "N")]
    assert rows[0]["u"]["east"] == pytest.approx(391370.6, abs=5000) and rows[0]["u"]["north"] == pytest.approx(5817850, abs=5000)
    for southern in (False, True):
        part = df.where(F.col("lat") < 0 if southern else F.col("lat") >= 0)
        lat, lon = projections.utm_inverse("u.east", "u.north", "u.zone", southern)
        for r in part.select("lat", "lon", lat.alias("a"), lon.alias("o")).collect():
            assert r["a"] == pytest.approx(r["lat"], abs=1e-7) and (r["o"] - r["lon"] + 180) % 360 - 180 == pytest.approx(0, abs=1e-7)


def test_conics_keep_their_promise(spark):
    df = spark.createDataFrame([(40.0, -100.0), (40.001, -100.0), (40.0, -99.999)], "lat double, lon double")
    at = lambda f: [tuple(r) for r in df.select(*f("lat", "lon", 29.5, 45.5, 23.0, -96.0)).collect()]
    step = [math.radians(0.001) * projections.A, math.radians(0.001) * projections.A * math.cos(math.radians(40))]
    for f, same in ((projections.lcc, "shape"), (projections.aea, "area"), (projections.eqdc, "meridian")):
        o, n, e = at(f)
        north, east = math.dist(o, n) / step[0], math.dist(o, e) / step[1]
        assert {"shape": north / east, "area": north * east, "meridian": north}[same] == pytest.approx(1, abs=1e-3)


def test_json_writes(spark):
    assert documents.placed(None, "a.b", 1) == '{"a":{"b":1}}' and documents.placed('{"a":[1,2]}', "a.1", "x") == '{"a":[1,"x"]}' and documents.placed('{"a":[1]}', "a.-1", 5) == '{"a":[1,5]}'
    df = spark.createDataFrame([('{"a":{"b":1},"c":2}',), (None,), ("{}",)], "d string")
    rows = df.select(documents.json_set(F.col("d"), "a.z", "true").alias("s"), documents.json_delete(F.col("d"), "a.b").alias("x")).collect()
    assert [tuple(r) for r in rows] == [('{"a":{"b":1,"z":true},"c":2}', '{"a":{},"c":2}'), ('{"a":{"z":true}}', None), ('{"a":{"z":true}}', None)]
    assert documents.inferred("12") == 12 and documents.inferred("12", string=True) == "12" and documents.inferred("[1]", raw=True) == [1] and documents.inferred("[1]") == "[1]"


def test_vector_tiles(spark):
    feats = [(1, {"type": "Point", "coordinates": [5, 5]}, {"n": -3, "s": "x", "f": 1.5, "b": True}), (2, geo.rectangle(0, 0, 10, 5), {"s": "x", "none": None}), (3, {"type": "LineString", "coordinates": [[0, 10], [10, 0]]}, {})]
    got = mvt.decode(mvt.encode("layer", feats, (0, 0, 10, 10)))["layer"]
    assert [g[0] for g in got] == [1, 2, 3] and got[0][1:] == ("Point", [[[2048, 2048]]], {"n": -3, "s": "x", "f": 1.5, "b": True})
    assert got[1][1] == "Polygon" and sorted(map(tuple, got[1][2][0])) == [(0, 2048), (0, 4096), (4096, 2048), (4096, 4096)] and got[2][2] == [[[0, 0], [4096, 4096]]]
    df = spark.createDataFrame([(0, 0, 0, 7, geo.to_wkb(feats[0][1]), "x")], "z int, x int, y int, id long, geom binary, name string")
    assert mvt.decode(bytes(mvt.tiles(df, "l", ["name"]).first()["mvt"]))["l"][0][3] == {"name": "x"}


def test_point_texts(spark):
    df = spark.createDataFrame([(1, "bus", 37.77, -122.41, 5), (2, "bus", 37.78, -122.42, 6), (3, "car", 37.77, -122.41, 7), (4, "bus", 10.0, 10.0, 8)], "id long, collection string, lat double, lon double, ts long")
    assert [r["id"] for r in points.run(df, "NEARBY bus 37.77 -122.41 5").collect()] == [1, 2]
    assert {r["id"] for r in points.run(df, "WITHIN bus 37 -123 38 -122 LIMIT 10").collect()} == {1, 2}
    assert {r["id"] for r in df.where(points.parse_filter('collection == bus AND (id >= 2 OR id ^ 1) AND NOT id == 4 AND other == 5')).collect()} == {1, 2}
    for bad in ("NEARBY bus 91 0 5", "NEARBY bus 0 0 0", "NEARBY bus 0 nan 5", "WITHIN bus 5 0 1 1", "NEARBY bus 0 0 5 LIMIT 20000", "FLY bus"):
        with pytest.raises(ValueError):
            points.run(df, bad)
    with pytest.raises(ValueError):
        points.parse_filter("id == ")


def test_plane_points_compares_latitudes_like_its_sql(spark, monkeypatch):
    lats = [92.999 - 90, 93.001 - 90, 2.999, 3.001, 3.0]  # the first two are just outside
    monkeypatch.setattr(queries_more, "points", lambda s, d: s.createDataFrame(list(enumerate(lats)), "id int, lat double").withColumn("lon", F.lit(5.0)))
    assert [r["near"] for r in queries_more.plane_points(spark, "").orderBy("id").collect()] == [False, False, True, True, True]
