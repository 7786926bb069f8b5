from collections import Counter

import corpus_pipeline
from geoweft.llm import quality
from geoweft.llm.common import table, written
from geoweft.llm.queries import QUERIES

from ..conftest import SMALL
from .test_similarity import expected_groups
from .test_texts import expected


def test_stages_against_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    stages, out = dict(corpus_pipeline.STAGES), {}
    for name, f in stages.items():
        docs = written(f(spark, docs, SMALL), f"test-{name}")
        out[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == table(spark, SMALL, "documents").columns
    given = table(spark, SMALL, "documents")
    model = quality.cotrain(given, table(spark, SMALL, "labels"))
    assert Counter(r["doc_id"] for r in out["quality"]) == Counter(r["doc_id"] for r in quality.judged(given, model).where("gw_keep").collect())
    bad = {r["doc_id"] for r in table(spark, SMALL, "labels").where("quality = 0").collect()}
    assert not bad - {r["doc_id"] for r in given.collect()} and len(bad & {r["doc_id"] for r in out["quality"]}) <= 1

    good = sorted(out["quality"], key=lambda r: r["doc_id"])
    root = expected_groups([r["text"] for r in good])  # five words, 0.8, by trying all pairs
    assert sorted(r["doc_id"] for r in out["near_duplicates"]) == sorted(good[i]["doc_id"] for i in set(root.values()))
    assert len(set(root.values())) < len(good)

    bench = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    leaks = {d for d, _ in expected([(r["doc_id"], r["text"]) for r in out["near_duplicates"]], bench)}
    assert sorted(r["doc_id"] for r in out["decontamination"]) == sorted({r["doc_id"] for r in out["near_duplicates"]} - leaks) and leaks
    assert Counter(map(tuple, out["mixing"])) == Counter(map(tuple, out["decontamination"]))
    assert sorted(r["doc_id"] for r in out["sharding"]) == sorted(r["doc_id"] for r in out["mixing"])


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(QUERIES) < set(names) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
