import itertools
import zlib
from collections import Counter, defaultdict

import pytest

from geoweft.llm import mixing, sharding

from .data import documents, frame


def least_capacity(sizes, shards):
    """Smallest capacity by trying every sum of a run."""
    sums = sorted({sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i, len(sizes) + 1)})

    def fits(c):
        used, here = 1, 0
        for s in sizes:
            if s > c:
                return False
            if here + s > c:
                used, here = used + 1, 0
            here += s
        return used <= shards

    return next(c for c in sums if fits(c))


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_shards(spark, shards):
    docs = frame(spark)
    rows = sharding.shard(docs, shards).collect()
    given = documents()
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in given)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_text = defaultdict(set)
    for r in rows:
        by_text[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(v) == 1 for k, v in by_text.items() if k[1] > 8)


@pytest.mark.parametrize(("shards", "bins"), [(4, 1 << 16), (7, 64), (24, 32)])
def test_capacity_is_minimal(spark, shards, bins):
    slim = sharding.slim(frame(spark)).cache()
    groups = defaultdict(int)
    for r in slim.collect():
        groups[r["gw_key"]] += r["size"]
    sizes = [groups[k] for k in sorted(groups)]
    ends, capacity = sharding.plan(slim, shards, max_bins=bins, first_bits=3)
    assert capacity == least_capacity(sizes, shards)
    shard_of = [sum(k > e for e in ends) for k in sorted(groups)]
    load = Counter()
    for s, size in zip(shard_of, sizes, strict=True):
        load[s] += size
    assert shard_of == sorted(shard_of) and max(load.values()) <= capacity


def test_no_documents(spark):
    assert sharding.shard(frame(spark, [])).count() == 0 and mixing.mix(frame(spark, [])).count() == 0


def test_mix_places_every_row_once(spark):
    docs = frame(spark)
    rows = mixing.mix(docs, {"a": 3, "b": 2}, block_rows=4).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((d[0], d[1]) for d in documents())
    assert len({(r["gw_slot"], r["gw_place"]) for r in rows}) == len(rows)
    assert {r["gw_slot"] for r in rows} == set(range(max(r["gw_slot"] for r in rows) + 1))
    assert all(len({r["source"] for r in rows if r["gw_slot"] == s}) == 1 for s in {r["gw_slot"] for r in rows})


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 5, "b": 3, "c": 1}, {"a": 7, "b": 7, "c": 1, "d": 2}, {"x": 13, "y": 1, "z": 1}])
def test_deviation_below_one_block(weights):
    pattern, total, done = mixing.period(weights, sorted(weights)), sum(weights.values()), Counter()
    assert Counter(pattern) == Counter(weights)
    for t, s in enumerate(pattern):
        done[s] += 1
        assert all(abs(done[x] - w * (t + 1) / total) < 1 for x, w in weights.items())


def test_schedule_covers_all_blocks():
    for blocks in itertools.product([1, 4, 9], repeat=3):
        plan = mixing.schedule(dict(zip("abc", blocks, strict=True)), {"a": 3, "b": 2, "c": 1})
        slots = []
        for s, pieces in plan:
            for k in range(dict(zip("abc", blocks, strict=True))[s]):
                k0, base, period, n, at = [p for p in pieces if p[0] <= k][-1]
                slots.append(base + (k - k0) // n * period + at[(k - k0) % n])
        assert sorted(slots) == list(range(sum(blocks)))


def test_bad_weights(spark):
    with pytest.raises(ValueError):
        mixing.mix(frame(spark), {"a": 0})
