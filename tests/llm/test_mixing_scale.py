import random
from collections import Counter

from pyspark.sql import functions as F

from geoweft.llm import mixing

from .data import documents, frame


def test_more_sources_than_the_driver_holds_at_once(spark):
    """The schedule is written in parts and joined by shuffle; the places are those of the broadcast one."""
    rng = random.Random(1)
    rows = [(i, f"s{int(40 * rng.random() ** 3)}") for i in range(4000)] + [(9000, None)]
    docs, weights = spark.createDataFrame(rows, "doc_id bigint, source string"), {"s0": 7, "s1": 3}
    places = lambda most: sorted(tuple(r) for r in mixing.mix(docs, weights, block_rows=3, most=most).select("doc_id", "gw_block", "gw_slot", "gw_place").collect())
    few = places(50)
    assert few == places(mixing.MAX_PATTERN) and [d for d, *_ in few] == sorted(d for d, _ in rows)
    assert len({(s, p) for _, _, s, p in few}) == len(rows)


def test_every_prefix_of_the_mix_keeps_the_weights(spark):
    """Over the returned rows: as long as a set of sources lasts, each is within one block of its share, counted from where the set began."""
    rows = [(i, "abc"[0 if i < 700 else 1 if i < 1000 else 2]) for i in range(1100)]
    weights = {"a": 5, "b": 2, "c": 1}
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string"), weights, block_rows=8).select("source", "gw_slot").distinct().orderBy("gw_slot").collect()
    left = {s: -(-n // 8) for s, n in Counter(s for _, s in rows).items()}
    assert [r["gw_slot"] for r in got] == list(range(sum(left.values())))
    active, done, since = set(left), Counter(), 0
    for r in got:
        done[r["source"]] += 1
        since += 1
        total = sum(weights[s] for s in active)
        assert all(abs(done[s] - since * weights[s] / total) < 1 for s in active)
        left[r["source"]] -= 1
        if not left[r["source"]]:
            active, done, since = active - {r["source"]}, Counter(), 0


def test_columns_of_any_name_stay(spark):
    docs = frame(spark).withColumn("gw_source", F.lit("mine")).withColumn("gw_n", F.lit(4)).withColumn("gw_slot", F.lit("old")).withColumn("gw_k0", F.lit(1)).withColumn("a.b", F.lit(2))
    got = mixing.mix(docs, {"a": 2}, block_rows=4)
    assert got.columns == [*[c for c in docs.columns if c != "gw_slot"], "gw_block", "gw_slot", "gw_place"]
    assert got.where("gw_source = 'mine' and gw_n = 4 and gw_k0 = 1 and `a.b` = 2 and gw_slot >= 0").count() == len(documents())
