import pytest
from pyspark.sql import functions as F

from geoweft.functions import geometry as geo
from geoweft.functions import values
from geoweft.operators import store
from geoweft.plans.commands import Engine

SCHEMA = f"key string, id string, lat double, lon double, z double, value string, fields map<string, {values.VALUE}>, geom binary, expires bigint"
N = lambda x: (values.NUMBER, float(x), str(x))
S = lambda x: (values.STRING, 0.0, x)


def row(key, id_, lat=None, lon=None, value=None, fields=None, geom=None, expires=0):
    return (key, id_, lat, lon, 0.0, value, fields or {}, geo.to_wkb(geom) if geom else None, expires)


@pytest.fixture(scope="module")
def engine(spark):
    rows = [row("mykey", i, a, o) for i, (a, o) in {"1": (5.0, 5.0), "2": (19.0, 19.0), "3": (12.0, 19.0), "4": (-5.0, 5.0), "5": (33.0, 21.0), "6": (52.0, 13.0)}.items()]
    near = (33.522, -112.28)
    for i in range(1, 8):
        f = {}
        if i <= 4:
            f["field1"] = N(10 * i)
        if i <= 5:
            f["field2"] = N([11, 10, 13, 14, 15][i - 1])
        if i in (5, 6):
            f["field3"] = N(23 + i)
        rows.append(row("fields", str(i), near[0] + i / 1000, near[1], fields=f))
    rows.append(row("fleet", "truck1", 33.0, -112.0, fields={"speed": N(45), "hello": (values.JSON, 0.0, '{"world":"tom"}'), "kind": S("Van")}))
    rows.append(row("fleet", "truck2", 33.1, -112.0, fields={"speed": N(90)}))
    rows.append(row("names", "a", value="zebra"))
    rows.append(row("names", "b", value="apple", expires=50))
    rows.append(row("names", "c", value="apricot"))
    rows.append(row("shapes", "poly", 5.0, 5.0, geom=geo.rectangle(2, 2, 8, 8)))
    rows.append(row("shapes", "far", 50.0, 50.0, geom=geo.rectangle(49, 49, 51, 51)))
    return Engine(spark.createDataFrame(rows, SCHEMA), {"fast": lambda argv: values.lt(values.constant(argv[0]), values.field("speed"))})


def ids(df):
    return [r["id"] for r in df.collect()]


def test_nearby_order_and_distance(engine):
    rows = engine.run("NEARBY mykey DISTANCE IDS POINT 20 20").collect()
    assert [r["id"] for r in rows] == ["2", "3", "5", "1", "4", "6"]
    assert [r["distance"] for r in rows[:3]] == pytest.approx([152808.67164037024, 895945.1409106688, 1448929.5916252395], rel=1e-9)
    assert ids(engine.run("NEARBY mykey IDS POINT 20 20 900000")) == ["2", "3"]


@pytest.mark.parametrize(
    ("command", "want"),
    [
        ("SCAN fields WHERE field1 10 30 IDS", ["1", "2", "3"]), ("SCAN fields WHERE field1 (10 30 IDS", ["2", "3"]), ("SCAN fields WHERE field1 0 0 IDS", ["5", "6", "7"]),
        ("SCAN fields WHERE field2 13 +inf IDS", ["3", "4", "5"]), ("SCAN fields WHEREIN field3 2 28 29 IDS", ["5", "6"]), ("SCAN fields WHERE 'field1 == 10 || field3 > 28' IDS", ["1", "6"]),
        ("SCAN fleet WHERE 'hello.world == \"TOM\"' IDS", ["truck1"]), ("SCAN fleet WHERE speed > 50 IDS", ["truck2"]), ("SCAN fleet WHERE 'kind =~ \"^V\"' IDS", ["truck1"]), ("SCAN fleet WHERE 'kind =~ \"(\"' IDS", []),
        ("SCAN fleet WHERE 'id.match(\"TRUCK*\") && speed < 50' IDS", ["truck1"]), ("SCAN fleet WHEREEVAL fast 1 50 IDS", ["truck2"]), ("SCAN fields DESC LIMIT 2 IDS", ["7", "6"]), ("SCAN fields CURSOR 2 LIMIT 2 WHERE field1 0 100 IDS", ["3", "4"]),
        ("SEARCH names IDS", ["b", "c", "a"]), ("SEARCH names MATCH ap* DESC IDS", ["c", "b"]), ("SCAN fleet MATCH truck[2-9] IDS", ["truck2"]), ("WITHIN shapes IDS BOUNDS 0 0 10 10", ["poly"]),
        ("INTERSECTS shapes IDS CIRCLE 8.2 5 50000", ["poly"]), ("WITHIN mykey IDS SECTOR 0 0 3000000 0 90", ["1", "2", "3"]), ("WITHIN mykey IDS GET shapes poly", ["1"]), ("WITHIN mykey SPARSE 1 IDS BOUNDS -10 0 60 30", ["1", "2", "5", "6"]),
    ],
)
def test_search_commands(engine, command, want):
    assert ids(engine.run(command)) == want


def test_other_commands(engine):
    assert engine.run("SCAN fields COUNT").first()["count"] == 7
    assert [r["key"] for r in engine.run("KEYS f*").collect()] == ["fields", "fleet"]
    assert engine.run("FGET fleet truck1 nothing").first()["value"] == "0" and engine.run("FGET fleet truck1 speed").first()["value"] == "45"
    assert tuple(engine.run("BOUNDS mykey").first()) == (-5.0, 5.0, 52.0, 21.0)
    assert engine.run("EXISTS fleet truck9").first()[0] == 0 and engine.run("TYPE fleet").first()[0] == "hash" and engine.run("TYPE no").first()[0] == "none"
    assert engine.run("TTL fleet truck1").first()[0] == -1.0 and engine.run("TTL fleet truck9").first()[0] == -2.0
    assert engine.run("GET mykey 1 HASH 5").first()["hash"] == "s0gs3"
    assert {r["key"]: r["num_objects"] for r in engine.run("STATS fleet none").collect()} == {"fleet": 2, "none": None}


@pytest.mark.parametrize(
    ("command", "want"),
    [
        ("TEST POINT 5 5 WITHIN BOUNDS 0 0 10 10", 1), ("TEST POINT 5 15 WITHIN BOUNDS 0 0 10 10", 0), ("TEST POINT 5 5 WITHIN NOT BOUNDS 0 0 10 10", 0), ("TEST POINT 5 5 INTERSECTS BOUNDS 20 20 30 30 OR BOUNDS 0 0 10 10", 1),
        ("TEST POINT 5 5 INTERSECTS BOUNDS 0 0 10 10 AND NOT ( BOUNDS 4 4 6 6 )", 0), ("TEST GET shapes poly WITHIN BOUNDS 0 0 10 10", 1), ("TEST QUADKEY 0 INTERSECTS TILE 0 0 1", 1),
    ],
)
def test_test(engine, command, want):
    assert engine.run(command).first()["result"] == want


@pytest.mark.parametrize(
    "command", ["SCAN", "SCAN fields LIMIT 0", "SCAN fields LIMIT 1 LIMIT 2", "NEARBY fields ASC POINT 1 1", "WITHIN mykey IDS BOUNDS 1 2 3", "WITHIN a IDS SECTOR 1 1 100 90 90", "NEARBY mykey POINT nan 1", "WITHIN a IDS QUADKEY 9", "SCAN fields IDS extra", "WITHIN a IDS HASH a!", "JUMP a"]
)
def test_bad_commands(engine, command):
    with pytest.raises(ValueError):
        engine.run(command)


def test_value_kinds(spark):
    texts = ["12", "-0.5", "000123", "null", "true", "false", '{"a": 1}', '"quoted"', "word", " 7 ", "inf", "[1", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", values.value_of("t").alias("v")).orderBy("i").collect()
    kinds = [r["v"]["kind"] for r in rows]
    assert kinds == [values.NUMBER, values.NUMBER, values.STRING, values.NULL, values.TRUE, values.FALSE, values.JSON, values.STRING, values.STRING, values.NUMBER, values.NUMBER, values.STRING, values.STRING]
    assert rows[6]["v"]["data"] == '{"a":1}' and rows[7]["v"]["data"] == "quoted"
    same = spark.range(1).select(*[values.constant(t).alias(f"c{i}") for i, t in enumerate(texts)]).first()
    assert [(c["kind"], c["data"]) for c in same] == [(r["v"]["kind"], r["v"]["data"]) for r in rows]


def test_store(spark, engine):
    table = engine.objects
    change = spark.createDataFrame([row("fleet", "truck1", 1.0, 2.0, fields={"speed": N(0), "new": N(3)}), row("fleet", "truck3", 1.0, 1.0)], SCHEMA)
    after = store.put(table, change)
    got = {r["id"]: r for r in after.where("key = 'fleet'").collect()}
    assert set(got) == {"truck1", "truck2", "truck3"} and got["truck1"]["lat"] == 1.0 and set(got["truck1"]["fields"]) == {"hello", "kind", "new"}
    assert store.put(table, change, "NX").count() == table.count() + 1 and store.put(table, change, "XX").count() == table.count()
    assert store.delete(table, "fleet", patterns=["*1"]).where("key = 'fleet'").count() == 1
    assert store.rename(table, "fleet", "names").where("key = 'names'").count() == 2
    with pytest.raises(ValueError):
        store.rename(table, "nothing", "x")
    assert store.live(table, 60).count() == table.count() - 1 and store.expire(table, "fleet", ["truck1"], 5).where("expires = 5").count() == 1
    assert store.set_fields(table, change).where(F.col("id") == "truck1").first()["lat"] == 33.0
