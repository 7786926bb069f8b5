import datetime

from pyspark.sql import functions as F

from geoweft.operators import fences
from geoweft.queries import positions, zones
from geoweft.streaming import fences as live

from .conftest import SMALL


def drained(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_stream_equals_batch(spark, tmp_path):
    moves = positions(spark, SMALL).where("id < 12").withColumn("seq", F.col("ts") * 1000 + F.col("seq") % 1000).select(F.col("id").cast("string").alias("id"), "ts", "seq", "lat", "lon")
    moves.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = drained(live.fence_events(spark.readStream.schema(moves.schema).parquet(str(tmp_path / "in")), zones(spark, SMALL)), "fence_events")
    batch = fences.messages(fences.observed(fences.with_last(moves), zones(spark, SMALL)), ["enter", "exit", "cross", "inside"]).select("id", "seq", "hook", F.col("message").alias("detect"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_expiry(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    for i, rows in enumerate([[("a", t), ("b", t)], [("b", t + datetime.timedelta(seconds=50))], [("b", t + datetime.timedelta(seconds=200))]]):
        spark.createDataFrame(rows, "id string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema("id string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = {r["id"] for r in drained(live.expiries(source, 60_000), "expired").collect()}
    assert "a" in got


def test_subscriptions(spark):
    m = spark.createDataFrame([("news", 1), ("news.eu", 2), ("sport", 3)], "channel string, n int")
    assert {r["n"] for r in live.subscribed(m, ["sport"], ["news.*"]).collect()} == {2, 3}
    assert {r["n"] for r in live.subscribed(m, ["sport"]).collect()} == {3}
