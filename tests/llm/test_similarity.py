import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoweft.llm import similarity

from .data import documents, frame, prose
from .test_simhash import LOW, classes


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {" ".join(w)}


def alike(a, b, least=0.8):
    return len(a & b) >= least * len(a | b)


def expected_groups(texts):
    """Least index of each text's group by trying all pairs."""
    sets = [shingle_set(t) for t in texts]
    return classes(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])])


def copies(rng, n, base, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def near_copies():
    rng, rows = random.Random(12), documents()
    texts = copies(rng, 70, prose(rng, 150), 4) + copies(rng, 30, prose(rng, 300), 12)
    passage = prose(rng, 60)
    texts += [prose(rng, rng.randint(5, 60)) + " " + passage + " " + prose(rng, rng.randint(5, 60)) for _ in range(60)]
    texts += ["two words", "Two  words", "TWO WORDS\n", "two other", "\t", "one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten eleven"]
    return rows + [(9000 + i, t, "en", "a", 1, 7, "x", "y", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("tile", [512, 6])
def test_groups_against_all_pairs(spark, tile):
    rows = near_copies()
    got = similarity.grouped(frame(spark, rows), tile=tile).select("gw_root", F.col("doc_id")).collect()
    assert len(got) == len(rows)
    root = expected_groups([r[1] for r in rows])
    want = Counter()
    for i, r in enumerate(rows):
        want[root[i], r[0]] += 1
    mine = {}
    for r in got:
        mine.setdefault(r["gw_root"], Counter())[r["doc_id"]] += 1
    theirs = {}
    for (k, d), n in want.items():
        theirs.setdefault(k, Counter())[d] += n
    key = lambda c: sorted((str(d), n) for d, n in c.items())
    assert sorted(map(key, mine.values())) == sorted(map(key, theirs.values()))


@pytest.mark.parametrize("tile", [512, 6])
def test_first_of_each_group_stays(spark, tile):
    rows = near_copies()
    docs = frame(spark, rows).withColumn("gw_text", F.lit("mine")).withColumn("gw_root", F.lit(3)).withColumn("gw_best_id", F.lit(None).cast("long"))
    kept = similarity.first_of_each(docs, tile=tile)
    assert kept.columns == docs.columns and kept.where("gw_text = 'mine' and gw_root = 3").count() == kept.count()
    root, best = expected_groups([r[1] for r in rows]), {}
    for i, r in enumerate(rows):
        rank = (r[0] is None, r[0] or 0)
        best[root[i]] = min(best.get(root[i], rank), rank)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(None if late else d for late, d in best.values())


def test_shingle_sets():
    texts = ["a b c d e f", "A B  c\td e\nF", "a b c d e f a b c d e f", None, "", "x", "y", "a b", "a  B"]
    h, at = similarity.shingle_sets(pa.array(texts), 5)
    sets = [tuple(h[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert [len(s) for s in sets] == [2, 2, 6, 1, 1, 1, 1, 1, 1] and sets[0] == sets[1] and set(sets[0]) < set(sets[2])
    assert sets[3] == sets[4] == (0,) and sets[5] != sets[6] and sets[7] == sets[8] and all(list(s) == sorted(s) for s in sets)


def test_exact_similarity_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 10**6, 60)
    parts = [np.unique(np.where(rng.random(60) < 0.12, rng.integers(0, 10**6, 60), base)).astype(np.uint64) for _ in range(25)] + [np.zeros(1, np.uint64)] * 2
    at, h = np.concatenate(([0], np.cumsum([len(p) for p in parts]))), np.concatenate(parts)
    want = {(i, j) for j in range(27) for i in range(j) if alike(set(parts[i].tolist()), set(parts[j].tolist()))}
    for columns in (4096, 7):
        monkeypatch.setattr(similarity, "COLUMNS", columns)
        assert set(zip(*(x.tolist() for x in similarity.alike(h, at, 0.8)), strict=True)) == want and len(want) > 1


def test_no_documents(spark):
    assert similarity.first_of_each(frame(spark, [])).count() == 0 and similarity.grouped(frame(spark, [])).count() == 0
