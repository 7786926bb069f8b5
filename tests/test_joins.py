import math
import random

from pyspark.sql import functions as F

from geoweft.operators import joins


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 6371.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def table(spark, rows, names):
    return spark.createDataFrame(rows, names)


def test_radius_join_everywhere(spark):
    rng = random.Random(5)
    a = [(i, rng.choice([rng.uniform(-90, 90), rng.uniform(85, 90)]), rng.choice([rng.uniform(-180, 180), rng.uniform(178, 180)])) for i in range(250)] + [(900, 90.0, 0.0), (901, -90.0, 10.0), (902, 0.0, 180.0), (903, None, 1.0)]
    b = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(120)] + [(800, 89.9, -170.0), (801, 0.1, -179.95), (802, -90.0, 0.0)]
    left, right = table(spark, a, "id long, lat double, lon double"), table(spark, b, "rid long, rlat double, rlon double")
    for r in (50.0, 700.0, 6000.0):
        got = {(x["id"], x["rid"]) for x in joins.radius_join(left, right, r).collect()}
        assert got == {(i, j) for i, la, lo in a if la is not None for j, ra, ro in b if km((la, lo), (ra, ro)) <= r}


def test_knn_join(spark):
    rng = random.Random(6)
    a = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)]
    b = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(40)]
    got = joins.knn_join(table(spark, a, "id long, lat double, lon double"), table(spark, b, "rid long, rlat double, rlon double"), 3, "id", "rid", first_km=300.0).collect()
    found = {i: [r["rid"] for r in sorted((r for r in got if r["id"] == i), key=lambda r: r["rank"])] for i, _, _ in a}
    assert found == {i: [j for _, j in sorted((km((la, lo), (ra, ro)), j) for j, ra, ro in b)[:3]] for i, la, lo in a}


def test_dense_rows_do_not_meet_all_within_the_first_radius(spark, monkeypatch):
    rng = random.Random(7)
    at = lambda: (rng.choice([rng.uniform(-90, 90), rng.uniform(84, 90), -90.0]), rng.choice([rng.uniform(-180, 180), rng.uniform(178, 180), -180.0]))
    a = [(i, *at()) for i in range(150)]
    b = [(i, *at()) for i in range(1500)] + [(2000 + i, 89.99, 10.0) for i in range(5)]
    left, right = table(spark, a, "id long, lat double, lon double"), table(spark, b, "rid long, rlat double, rlon double")

    met, radius_join = [], joins.radius_join
    monkeypatch.setattr(joins, "radius_join", lambda rest, *more, **at: met.append(rest.count()) or radius_join(rest, *more, **at))
    got = joins.knn_join(left, right, 3, "id", "rid", first_km=5000.0).collect()
    found = {i: [r["rid"] for r in sorted((r for r in got if r["id"] == i), key=lambda r: r["rank"])] for i, _, _ in a}
    assert found == {i: [j for _, j in sorted((km((la, lo), (ra, ro)), j) for j, ra, ro in b)[:3]] for i, la, lo in a}
    assert sum(met) <= 4  # two rows lie in a cell with two others


def test_a_crowded_cell_is_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(joins, "SMALL", 10)
    monkeypatch.setattr(joins, "UNIT", 500)
    rng = random.Random(8)
    a = [(i, rng.choice([rng.uniform(-90, 90), 89.9]), rng.uniform(-180, 180)) for i in range(300)] + [(900, None, 1.0)]
    b = [(i, rng.choice([rng.uniform(-90, 90), 89.8]), rng.uniform(-180, 180)) for i in range(120)]
    left, right = table(spark, a, "id long, lat double, lon double"), table(spark, b, "rid long, rlat double, rlon double")
    for r in (50.0, 700.0, 6000.0):
        got = [(x["id"], x["rid"]) for x in joins.radius_join(left, right, r).collect()]
        assert len(got) == len(set(got)) and set(got) == {(i, j) for i, la, lo in a if la is not None for j, ra, ro in b if km((la, lo), (ra, ro)) <= r}
    x, y = joins.dealt(left.dropna().withColumn("__cell", joins.own_cell(F.col("lat"), F.col("lon"), 5.0)), right.withColumn("__touched", joins.own_cell(F.col("rlat"), F.col("rlon"), 5.0)))
    sides = x.groupBy("__a", "__apart").count().join(y.groupBy(F.col("__b").alias("__a"), F.col("__bpart").alias("__apart")).agg(F.count("*").alias("n")), ["__a", "__apart"])
    assert sides.agg(F.max(F.col("count") * F.col("n"))).first()[0] < 1500 < 100 * 40
