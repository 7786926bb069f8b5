from collections import Counter

from pyspark.sql import functions as F

from geoweft.llm import sharding

from .test_sharding_mixing import least_capacity


def test_one_large_group_among_many(spark):
    """Half of all bytes in one group: the rest's ranges are looked up, not listed in a predicate."""
    small = spark.range(50_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("short text "), F.col("id").cast("string")).alias("text"))
    copies = spark.range(50_000, 62_000).select(F.col("id").alias("doc_id"), F.lit("one text that very many documents hold as it is, from end to end").alias("text"))
    rows = sharding.shard(small.union(copies)).groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.sum("size").alias("s")).collect()
    assert sum(r["n"] for r in rows) == 62_000 and all(r["a"] == 0 and r["b"] == r["n"] - 1 for r in rows) and len(rows) == 24
    assert max(r["s"] for r in rows) == 12_000 * (8 + len("one text that very many documents hold as it is, from end to end"))


def test_thousands_of_ranges_to_split(spark):
    rows = spark.range(40_000).select(F.shiftrightunsigned(F.xxhash64("id"), 1).alias("gw_key"), (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(90)) + 8).alias("size")).cache()
    some = list(range(0, 1 << 14, 2))
    got = sharding.held_by(rows, some, sharding.KEY_BITS - 14).count()
    assert got == rows.where(F.shiftright("gw_key", sharding.KEY_BITS - 14) % 2 == 0).count()


def test_many_large_groups(spark):
    sizes = [(i, 1 + (i * 7919 % 13) ** 3) for i in range(400)] + [(1000 + i, 4000 + 977 * i) for i in range(9)]
    rows = spark.createDataFrame(sizes, "id long, size long").select(F.shiftrightunsigned(F.xxhash64("id"), 1).alias("gw_key"), "size").cache()
    ordered = [r["size"] for r in rows.orderBy("gw_key").collect()]
    for shards in (3, 24):
        ends, capacity = sharding.plan(rows, shards, max_bins=64, first_bits=2)
        low, high = max(max(ordered), -(-sum(ordered) // shards)), sum(ordered)
        while low < high:
            mid = (low + high) // 2
            used, here = 1, 0
            for s in ordered:
                used, here = (used, here + s) if here + s <= mid else (used + 1, s)
            low, high = (low, mid) if used <= shards else (mid + 1, high)
        assert capacity == low and len(ends) == shards - 1
    small = [3, 9, 1, 1, 30, 2]
    assert least_capacity(small, 3) == 30 and Counter(small)[1] == 2


def test_shard_numbers(spark):
    ends = [-1, 4, 4, 90]
    got = spark.range(100).select("id", sharding.above(F.col("id"), ends).alias("n")).collect()
    assert all(r["n"] == sum(r["id"] > e for e in ends) for r in got)
