import random

import pytest

from geoweft.functions import geometry as geo
from geoweft.sources import flatgeobuf as fgb

COLUMNS = [("name", "string"), ("n", "int"), ("big", "long"), ("x", "double"), ("ok", "bool"), ("raw", "binary")]
SHAPES = [
    {"type": "Point", "coordinates": [1.0, 2.0]}, {"type": "LineString", "coordinates": [[0.0, 0.0], [5.0, 5.0]]}, geo.rectangle(3, 3, 6, 6),
    {"type": "Polygon", "coordinates": [[[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0], [0.0, 0.0]], [[4.0, 4.0], [5.0, 4.0], [5.0, 5.0], [4.0, 4.0]]]},
    {"type": "MultiPoint", "coordinates": [[1.0, 1.0], [2.0, 2.0]]}, {"type": "MultiLineString", "coordinates": [[[0.0, 0.0], [1.0, 1.0]], [[2.0, 2.0], [3.0, 3.0]]]},
    {"type": "MultiPolygon", "coordinates": [geo.rectangle(0, 0, 1, 1)["coordinates"], geo.rectangle(5, 5, 6, 6)["coordinates"]]},
]


def test_round_trip(spark, tmp_path):
    fgb.register(spark)
    rows = [(geo.to_wkb(g), f"é{i}", i, 1 << 40, i / 2, bool(i % 2), b"\x00\x01") for i, g in enumerate(SHAPES)] + [(geo.to_wkb(SHAPES[0]), None, None, None, None, None, None)]
    fgb.write(str(tmp_path / "a.fgb"), rows, COLUMNS)
    got = spark.read.format("geofgb").option("path", str(tmp_path / "a.fgb")).option("rows", 3).load()
    assert got.dtypes[1:4] == [("name", "string"), ("n", "int"), ("big", "bigint")] and got.rdd.getNumPartitions() == 3
    key = lambda r: repr(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r))
    assert sorted(map(key, got.collect())) == sorted(map(key, rows))


def test_indexed_read(spark, tmp_path):
    fgb.register(spark)
    rng = random.Random(1)
    rows = [(geo.to_wkb({"type": "Point", "coordinates": [rng.uniform(-180, 180), rng.uniform(-90, 90)]}), i) for i in range(1500)]
    fgb.write(str(tmp_path / "b.fgb"), rows, [("id", "int")])
    for box in [(-10, -10, 40, 30), (-180, -90, 180, 90), (179.99, 89.99, 180, 90)]:
        want = {i for w, i in rows if box[0] <= geo.from_wkb(w)["coordinates"][0] <= box[2] and box[1] <= geo.from_wkb(w)["coordinates"][1] <= box[3]}
        got = spark.read.format("geofgb").option("path", str(tmp_path / "b.fgb")).option("bbox", ",".join(map(str, box))).load()
        assert {r["id"] for r in got.collect()} == want
    fgb.write(str(tmp_path / "d.fgb"), rows[:1], [("id", "int")])
    assert spark.read.format("geofgb").option("path", str(tmp_path / "d.fgb")).load().count() == 1
    fgb.write(str(tmp_path / "c.fgb"), rows[:50], [("id", "int")], node=0)
    assert spark.read.format("geofgb").option("path", str(tmp_path / "c.fgb")).load().count() == 50


def test_not_a_file(tmp_path):
    (tmp_path / "x").write_bytes(b"nothing to see here")
    with pytest.raises(ValueError):
        fgb.File(str(tmp_path / "x"))
