import pytest
from pyspark.sql import functions as F

from geoweft.functions import cells, planar, values
from geoweft.functions import geometry as geo
from geoweft.operators import fences, joins
from geoweft.plans.commands import Engine

from .test_commands import SCHEMA, row


@pytest.fixture(scope="module")
def engine(spark):
    rows = [row("fleet", "a", 10.0, 20.0), row("fleet", "b", 11.0, 21.0, fields={"speed": (values.NUMBER, 4.0, "4")}), row("names", "n", value="x")]
    rows.append(row("shapes", "poly", 5.0, 5.0, geom=geo.rectangle(2, 2, 8, 8)))
    return Engine(spark.createDataFrame(rows, SCHEMA), now_ns=0)


def test_bounds_are_those_of_the_shapes(engine):
    assert tuple(engine.run("BOUNDS shapes").first()) == (2.0, 2.0, 8.0, 8.0)
    assert tuple(engine.run("BOUNDS fleet").first()) == (10.0, 20.0, 11.0, 21.0)
    both = engine.write("SET fleet box BOUNDS -5 -6 1 2")
    assert tuple(both.run("BOUNDS fleet").first()) == (-5.0, -6.0, 11.0, 21.0)


def test_distance_to_a_shape_is_that_to_its_box(engine):
    near = engine.run("NEARBY shapes DISTANCE IDS POINT 5 9").first()
    assert near["id"] == "poly" and 110_000 < near["distance"] < 112_000
    assert engine.run("NEARBY shapes DISTANCE IDS POINT 5 5").first()["distance"] == 0


def test_set_merges_fields_and_replaces_content(engine):
    e = engine.write("SET fleet b FIELD load 3 EX 10 POINT 1 2 3")
    r = e.objects.where("id = 'b'").first()
    assert (r["lat"], r["lon"], r["z"], r["expires"]) == (1.0, 2.0, 3.0, 10_000_000_000)
    assert {k: v["num"] for k, v in r["fields"].items()} == {"speed": 4.0, "load": 3.0}
    assert e.write("FSET fleet b speed 0").objects.where("id = 'b'").first()["fields"].keys() == {"load"}
    assert engine.write("SET fleet b NX POINT 1 2").objects.where("id = 'b'").first()["lat"] == 11.0
    assert engine.write("SET fleet c XX POINT 1 2").objects.where("id = 'c'").count() == 0


@pytest.mark.parametrize("bad", ["SET fleet x CIRCLE 1 2 3", "SET fleet x POINT 1", "FSET fleet nobody speed 1", "FSET fleet a", "DEL fleet", "DEL fleet a b", "RENAME nothing other", "JSET names n a 1 ODD", "NOSUCH a"])
def test_bad_writes(engine, bad):
    with pytest.raises(ValueError):
        engine.write(bad)


def test_other_writes(engine):
    assert engine.write("PDEL fleet [ab]").objects.where("key = 'fleet'").count() == 0
    assert engine.write("RENAME fleet cars").run("KEYS *").count() == 3
    assert engine.write("FLUSHDB").objects.count() == 0
    assert engine.write("JSET names m a.b.0 5").run("JGET names m a").first()[0] is not None
    assert engine.write("EXPIRE fleet a 3").write("PERSIST fleet a").run("TTL fleet a").first()[0] == -1.0


def test_buffered_area(engine):
    assert [r["id"] for r in engine.run("WITHIN fleet IDS BOUNDS 9.5 19.5 9.9 19.9 BUFFER 30000").collect()] == ["a"]
    assert engine.run("WITHIN fleet IDS BOUNDS 9.5 19.5 9.9 19.9").count() == 0


def test_face_cell_ancestors(spark):
    df = spark.range(50).select((F.col("id") * 3.1 - 75).alias("lat"), (F.col("id") * 7.3 - 170).alias("lon")).select(cells.face_cell("lat", "lon", 28).alias("c"))
    for level in (0, 5, 12, 29):
        assert df.where(cells.face_cell_level(cells.face_cell_parent("c", level)) != level).count() == 0


def test_passed_equals_observed_without_outside(spark):
    rows = [(i, i % 4, float(i), 40 + (i * 37 % 200 - 100) / 50, -100 + (i * 53 % 200 - 100) / 50) for i in range(200)]
    changes = fences.with_last(spark.createDataFrame(rows, "seq long, id long, ts double, lat double, lon double"))
    zones = spark.createDataFrame([(f"h{k}", 40 + (k * 11 % 20 - 10) / 5, -100 + (k * 7 % 20 - 10) / 5, 5.0 + 9 * k) for k in range(12)], "hook string, flat double, flon double, fkm double")
    pick = lambda df: sorted((r["seq"], r["hook"], r["detect"]) for r in df.select("seq", "hook", "detect").collect())
    want = pick(fences.observed(changes, zones).where("detect <> 'outside'"))
    assert pick(fences.passed(changes, zones)) == want and {x[2] for x in want} == {"enter", "exit", "inside", "cross"}


def test_nearest_neighbours_on_the_other_side_of_the_globe(spark):
    left = spark.createDataFrame([(i, 1.0 + i, 2.0) for i in range(5)], "a int, lat double, lon double")
    right = spark.createDataFrame([(10, -1.0, -178.0), (11, -2.0, -179.0), (12, 1.5, 2.5)], "b int, rlat double, rlon double")
    got = joins.knn_join(left, right, 2, "a", "b", first_km=50.0)
    assert sorted((r["a"], r["rank"], r["b"]) for r in got.collect())[:2] == [(0, 1, 12), (0, 2, 11)] and got.count() == 10  # 10 is the antipode of row 0


def test_planar_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    r = df.select(planar.slope("x", "y", "x", F.lit(9.0)).alias("m"), planar.point_at("x", "y", "x", "y", F.lit(3.0)).alias("p"), planar.circle_of("x", "y", F.lit(2.0), F.lit(4.0), F.lit(3.0), F.lit(6.0)).alias("c"), planar.nearly(F.lit(float("nan")), F.lit(float("nan"))).alias("n")).first()
    assert r["m"]["slope"] is None and (r["p"]["x"], r["p"]["y"]) == (1.0, 2.0) and r["c"]["radius"] is None and r["n"]
    with pytest.raises(ValueError):
        planar.affine_inverse((0.0, 1.0, 2.0, 0.0, 2.0, 4.0))


def test_json_writes_do_not_multiply_the_plan(engine):
    e = engine
    for i in range(6):
        e = e.write(f"JSET names doc a.b{i} {i}").write(f"JDEL names doc a.b{i - 1}")
    e = e.write("JSET names doc c text").write("JDEL names n a").write("JDEL names nobody a")
    assert e.run("JGET names doc").collect() == [('{"a":{"b5":5},"c":"text"}',)]
    assert e.run("JGET names n").collect() == [("x",)] and e.objects.count() == engine.objects.count() + 1
    new = e.objects.where("id = 'doc'").first()
    assert (new["lat"], new["z"], new["geom"], new["fields"], new["expires"]) == (None, 0.0, None, {}, 0)
    assert e.objects._jdf.queryExecution().analyzed().toString().count("Union") == 1
