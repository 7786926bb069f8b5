import random
import re
from collections import Counter

import numpy as np
import xxhash

from geoweft.llm import simhash
from geoweft.llm.components import components

from .data import documents, frame

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(keys, links):
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}


def near(a, b):
    return bin(a ^ b).count("1") <= 4


def edited():
    rng, rows = random.Random(8), documents()
    words = rows[3][1].split()
    for i in range(40):
        w = list(words * 12)
        w[rng.randrange(len(w))] = "edited"
        rows.append((3000 + i, " ".join(w).upper(), "en", "a", 1, 7, "x", "y", 1))
    return rows


def test_against_brute_force(spark):
    rows = edited()
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    fp = {(r[0], r[1]): plain_fingerprint(r[1]) for r in rows}
    assert sorted(r["fingerprint"] for r in got) == sorted(f"{fp[r[0], r[1]]:016x}" for r in rows)
    prints = sorted(set(fp.values()))
    root = classes(prints, [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if near(a, b)])
    least = {}
    for (d, _), f in fp.items():
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    for r in got:
        assert r["component_id"] == least.get(root[int(r["fingerprint"], 16)])
    assert len({r["component_id"] for r in got if r["doc_id"] and r["doc_id"] >= 3000}) < 20


def test_one_of_each_stays(spark):
    rows = edited()
    kept = simhash.deduplicated(frame(spark, rows))
    assert kept.columns == frame(spark).columns
    got = kept.collect()
    groups = {r["gw_root"]: r["component_id"] for r in simhash.grouped(frame(spark, rows), 4, 4).collect()}
    assert Counter(r["doc_id"] for r in got) == Counter(groups.values())


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0 and simhash.deduplicated(frame(spark, [])).count() == 0


def test_bit_slices_equal_popcount():
    rng = np.random.default_rng(4)
    for n in (1, 2, 63, 64, 65, 300):
        base = rng.integers(0, 1 << 63, max(1, n // 5), dtype=np.int64).astype(np.uint64)
        fps = base[rng.integers(0, len(base), n)]
        for _ in range(3):
            fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        for radius in (0, 3, 4, 6):
            i, j = simhash.close_pairs(fps, radius)
            want = {(a, b) for a in range(n) for b in range(a + 1, n) if np.bitwise_count(fps[a] ^ fps[b]) <= radius}
            assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_hot_keys_are_tiled_without_losing_links(spark):
    rng = np.random.default_rng(2)
    cluster = np.unique(np.int64(0x0F0F0F0F00000000) ^ rng.integers(0, 1 << 14, 3000, dtype=np.int64))
    fps = spark.createDataFrame([(int(x),) for x in cluster], "gw_fp bigint")
    links = simhash.close_links(fps, tile=64)
    root = {r["u"]: r["v"] for r in components(links).collect()}
    want = classes(cluster.tolist(), [(int(cluster[a]), int(cluster[b])) for a, b in zip(*simhash.close_pairs(cluster.view(np.uint64)), strict=True)])
    assert {k: root.get(k, k) for k in cluster.tolist()} == want


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
