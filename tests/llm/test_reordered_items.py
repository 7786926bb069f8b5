import random

from geoweft.llm import decontamination

from .test_texts import expected


def test_reordered_items_are_found(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, items = [], []
    for i, (n, cut) in enumerate([(40, 20), (60, 30), (60, 11), (90, 45)]):
        item = fresh(n)
        items.append((i, " ".join(item)))
        rows.append((100 + i, " ".join(fresh(70) + item[cut:] + item[:cut] + fresh(50))))
        rows.append((200 + i, " ".join(fresh(9) + item[:cut] + fresh(n) + item[cut:] + fresh(9))))
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.contaminated(docs, bench).collect()}
    want = expected(rows, items)
    assert set(want) == {(100 + i, i) for i in range(4)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_fingerprints_of_few_and_of_many_shingles(spark):
    rng = random.Random(4)
    rows = [(n, [rng.randrange(-(2**63), 2**63) for _ in range(n)]) for n in (1, 2, 3, 17, 127, 128, 255, 256, 700)]
    df = spark.createDataFrame(rows, "n int, s array<bigint>")
    got = {r["n"]: r["fp"] % 2**64 for r in df.select("n", decontamination.simhash(df["s"]).alias("fp")).collect()}
    for n, s in rows:
        assert got[n] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in s) > n)


def test_copies_with_null_ids_and_clashing_names(spark):
    item = " ".join(f"i{k}" for k in range(30))
    rows = [(None, "a " + item), (None, "a " + item), (1, "a " + item), (2, None), (3, ""), (4, "x " * 20_000 + item + " y" * 9)]
    docs = spark.createDataFrame([(*r, 1, "t", 5) for r in rows], "doc_id bigint, text string, gw_text int, gw_bad string, gw_i int")
    bench = spark.createDataFrame([(7, item), (7, item), (8, item), (None, item), (9, None)], "item_id bigint, text string")
    got = decontamination.contaminated(docs, bench).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["start_word"], r["similarity"]) for r in got), key=repr) == sorted(((d, i, s, 1.0) for d, s in ((None, 1), (1, 1), (4, 20_000)) for i in (7, 8, None)), key=repr)
    kept = decontamination.decontaminated(docs, bench)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.orderBy("doc_id").collect()] == [(2, None, 1, "t", 5), (3, "", 1, "t", 5)]
