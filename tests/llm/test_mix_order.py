from collections import defaultdict

import corpus_pipeline
from geoweft.llm import mixing
from geoweft.llm.common import written
from geoweft.llm.queries import MIX_WEIGHTS

from .data import DOCS


def test_slots_within_shards_follow_the_mix(spark):
    rows = [(i, f"text number {i} of the test", "en", f"src{i % 7 if i < 2000 else 0}", 5, 7, "x", "y", 1) for i in range(3000)]
    docs, stages = spark.createDataFrame(rows, DOCS), dict(corpus_pipeline.STAGES)
    place = {r["doc_id"]: (r["gw_slot"], r["gw_place"]) for r in mixing.mix(docs, MIX_WEIGHTS).collect()}
    mixed = written(stages["mixing"](spark, docs, ""), "test-mixed")
    shards = defaultdict(list)
    for r in stages["sharding"](spark, mixed, "").collect():
        shards[r["shard"]].append((r["slot"], place[r["doc_id"]]))
    assert sum(map(len, shards.values())) == len(rows) and len(shards) == 24
    for found in shards.values():
        found.sort()
        assert [s for s, _ in found] == list(range(len(found)))
        assert [p for _, p in found] == sorted(p for _, p in found)
