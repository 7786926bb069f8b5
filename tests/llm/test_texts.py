import random
import re
from collections import Counter

import pytest

from geoweft.llm import decontamination, passages, secretscan

from .data import documents, frame, prose


def words(t):
    return [w for w in re.split("[ \t-\r]+", (t or "").lower()) if w]


def shingles(t, k=5):
    w = words(t)
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]


def similarity(a, b):
    both = sum((Counter(a) & Counter(b)).values())
    return both / (len(a) + len(b) - both)


def leaked():
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randint(12, 40))) for i in range(12)] + [(50, None), (51, ""), (52, "two words"), (53, "alpha beta alpha beta alpha beta alpha beta alpha beta")]
    rows = documents()
    for i in range(30):
        item = words(items[i % 12][1])
        if i % 3 == 1:
            item[0] = "changed"
        if i % 3 == 2:
            item.insert(len(item) // 2, "added")
        rows.append((4000 + i, prose(rng, 20) + " " + " ".join(item).title() + "\n" + prose(rng, 9), "en", "a", 1, 7, "x", "y", 1))
    rows.append((4100, "just two words here", "en", "a", 1, 7, "x", "y", 1))
    rows.append((4101, "alpha beta " * 40, "en", "a", 1, 7, "x", "y", 1))
    return rows, items


def expected(rows, items):
    out = {}
    for d, t, *_ in rows:
        for i, b in items:
            k = min(5, len(words(b)))
            if k == 0:
                continue
            s, item = shingles(t, k), shingles(b, k)
            best = max((similarity(s[a : a + len(item)], item) for a in range(max(1, len(s) - len(item) + 1)) if s), default=0)
            if best >= 0.8:
                out[d, i] = max(out.get((d, i), 0), best)
    return out


@pytest.mark.parametrize("block", [1 << 16, 60])
def test_decontamination_against_all_windows(spark, block):
    rows, items = leaked()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.contaminated(frame(spark, rows), bench, block=block).collect()}
    want = expected(rows, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_decontaminated_documents(spark):
    rows, items = leaked()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = frame(spark, rows)
    kept = decontamination.decontaminated(docs, bench)
    bad = {d for d, _ in expected(rows, items)}
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in rows if r[0] not in bad)
    assert decontamination.decontaminated(docs, spark.createDataFrame([], "item_id bigint, text string")).count() == len(rows)
    assert decontamination.contaminated(frame(spark, []), bench).count() == 0


def plain_runs(rows, least=10):
    units, seen = [], {}
    for d, t in sorted({(r[0], r[1]) for r in rows if r[1]}, key=lambda r: (r[0] is None, r[0] or 0)):
        for i, m in enumerate(passages.UNIT.finditer(t)):
            norm = " ".join(m[0].lower().split())
            units.append((d, t, i, m.start(), m.end(), len(norm.split()), norm))
    out, last = [], None
    for d, t, i, a, b, n, norm in units:
        first = norm not in seen
        seen.setdefault(norm, d)
        if first:
            last = None
        elif last and last[0] == (d, t):
            last[1:] = [last[1], b, last[3] + n]
        else:
            last = [(d, t), a, b, n]
            out.append(last)
    return Counter((x[0][0], x[1], x[2], x[3]) for x in out if x[3] >= least)


def repeating():
    rng = random.Random(5)
    shared = "One passage of many words that stands in several texts. It has a second sentence, too! And a third one follows here"
    rows = [r for r in documents() if r[0] != 6 or r[1] != "same id, other text"]
    rows += [(5000 + i, prose(rng, 12) + " then. " + shared + ". " + prose(rng, 7), "en", "a", 1, 7, "x", "y", 1) for i in range(6)]
    rows += [(5100 + i, f"Head {i}\nthis line is the same in every one of these twelve word texts\nTail {i}", "en", "a", 1, 7, "x", "y", 1) for i in range(8)]
    return rows


def test_repeats_against_plain_python(spark):
    rows = repeating()
    got = Counter((r["doc_id"], r["start"], r["stop"], r["words"]) for r in passages.repeated(frame(spark, rows)).collect())
    assert got == plain_runs(rows)
    assert {5001, 5002, 5101} <= {k[0] for k in got} and not {5000, 5100} & {k[0] for k in got}


def test_cut_texts(spark):
    rows = repeating()
    cut = {r["doc_id"]: r for r in passages.without_repeats(frame(spark, rows)).where("doc_id >= 5000").collect()}
    text = dict((r[0], r[1]) for r in rows)
    for d, r in cut.items():
        left, at = "", 0
        for s in r["gw_spans"]:
            left, at = left + text[d][at : s["start"]], s["stop"]
        assert r["gw_clean"] == left + text[d][at:]
    assert cut[5000]["gw_clean"] == text[5000] and "second sentence" not in cut[5001]["gw_clean"]
    assert passages.repeated(frame(spark, [])).count() == 0


def test_secrets(spark):
    forest = secretscan.grown(secretscan.example_findings(spark, 4000), trees=9)
    held = secretscan.example_findings(spark, 6000).orderBy("cand").collect()
    texts = [(i, f"{r['before2']} {r['before']} {r['raw']} {r['after']}", r["path"], r["label"]) for i, r in enumerate(held)]
    docs = spark.createDataFrame([(i, t, p) for i, t, p, _ in texts], "doc_id bigint, text string, source string")
    got = {}
    for r in secretscan.scanned(docs, forest).collect():
        got[r["doc_id"]] = max(got.get(r["doc_id"], 0.0), r["score"])
    right = sum((got.get(i, 0.0) >= 0.5) == bool(y) for i, _, _, y in texts)
    assert right / len(texts) > 0.95


def test_secret_candidates(spark):
    rows = documents() + [(6000, 'set token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" now', "en", None, 1, 7, "x", "y", 1), (6001, "a 1234567890123456 b api_key=abcDEF0123456789xyz", "en", "tests/a", 1, 7, "x", "y", 1)]
    got = {(r["doc_id"], r["word_no"], r["cand"]) for r in secretscan.candidates(frame(spark, rows)).collect()}
    assert got == {(6000, 4, "04dbebab91ab85687d33eeaaf9ac699e1188f962"), (6001, 2, "1234567890123456"), (6001, 4, "abcDEF0123456789xyz")}
    assert secretscan.candidates(frame(spark, [])).count() == 0
