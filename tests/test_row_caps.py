from pyspark.sql import functions as F

from geoweft import queries


def test_within_text_returns_every_row_of_its_box(spark, monkeypatch):
    many = spark.range(10_050).select("id", F.lit("MACHINERY").alias("collection"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.col("id").alias("ts"))
    monkeypatch.setattr(queries, "points", lambda spark, d: many)
    assert queries.within_text(spark, "").count() == 10_050
