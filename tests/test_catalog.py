from pyspark.sql import functions as F

from geoweft.operators import catalog, graph
from geoweft.queries import checkpoints


def test_bloom_filter(spark):
    rows = spark.range(2000).select((F.col("id") * 7).alias("x"))
    b = catalog.Bloom(rows, "x", 2000, 0.01)
    assert rows.where(~b.may_contain(F.col("x"))).count() == 0
    wrong = spark.range(20000).where("id % 7 <> 0").where(b.may_contain(F.col("id"))).count()
    assert wrong < 500 and b.false_positive_rate() < 0.03


def test_hooks(spark):
    r = spark.createDataFrame([("a1", "x"), ("a2", "y"), ("b", "z")], "hook string, key string")
    assert [x["hook"] for x in catalog.hooks(r, "a*").collect()] == ["a1", "a2"]
    assert {(x["hook"], x["key"]) for x in catalog.set_hooks(r, spark.createDataFrame([("b", "new"), ("c", "q")], r.schema)).collect()} == {("a1", "x"), ("a2", "y"), ("b", "new"), ("c", "q")}
    assert [x["hook"] for x in catalog.delete_hooks(r, "a?").collect()] == ["b"]


def test_routes(spark):
    checkpoints(spark)
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0), ("c", "d", 1.0), ("x", "a", 1.0)], "src string, dst string, cost double")
    assert graph.path(edges, "a", "d") == ["a", "b", "c", "d"] and graph.path(edges, "a", "x") == []


def test_orphans(spark):
    t, d = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1,)], "ref int")
    assert [r["id"] for r in catalog.without_dependants(t, "id", d, "ref").collect()] == [2]
