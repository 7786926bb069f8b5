import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from geoweft.llm import hmm, media, quality, toxicity
from geoweft.llm.common import flat_words, slices

from .data import documents, frame, prose

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def held(d, m, r):
    return zlib.crc32(("" if d is None else str(d)).encode()) % m == r


def test_words_and_slices():
    texts = ["  A b\x0bC\x1cd  e \r\n", None, "", "   ", "x y", "ÀÉ Ü\x85z"] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    seen = 0
    for part in slices(batch, most=40):
        flat, at = flat_words(part.column("text"))
        want = [tokens(t) for t in texts[seen : seen + part.num_rows]]
        assert [flat.to_pylist()[a:b] for a, b in itertools.pairwise(at)] == want
        seen += part.num_rows
    assert seen == len(texts)


def check_base(rows, got, m=7, r=2):
    count = Counter()
    for d, t, *_ in rows:
        if not held(d, m, r):
            count.update([*tokens(t), ""])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for d, t, *_ in rows:
        ts = [*tokens(t), ""]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ts)
        want[d, held(d, m, r), len(ts), sum(count[w] > 0 for w in ts), n, round(base, 6)] += 1
    assert Counter((x["doc_id"], x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in got) == want


def test_hmm_counts_and_scores(spark):
    rows = [(r[0], " ".join(w + "o" for w in r[1].split()) if r[1] and (r[0] or 0) % 2 else r[1], *r[2:]) for r in documents(300)]
    for head in (1 << 18, 4):
        got = hmm.language_scores(frame(spark, rows), classes=64, states=3, head=head).collect()
        check_base(rows, got)
        assert all(x["score"] < 0 and math.isfinite(x["score"]) for x in got)
        known = [x for x in got if x["held_out"] and x["n_tokens"] > 5]
        assert sum(x["score"] for x in known) > sum(x["base_score"] for x in known)


def test_hmm_without_documents_or_training(spark):
    assert hmm.language_scores(frame(spark, [])).count() == 0
    only = [r for r in documents() if held(r[0], 7, 2)]
    got = hmm.language_scores(frame(spark, only), classes=16, states=2).collect()
    assert len(got) == len(only) and all(x["train_tokens"] == 0 and x["base_score"] == 0 for x in got)


def test_forward_equals_sum_over_paths():
    rng = np.random.default_rng(0)
    model = hmm.Model.first(3, 5)
    model.move = rng.dirichlet(np.ones(3), 3)
    seq, at = rng.integers(0, 6, 11).astype(np.int32), np.array([0, 4, 5, 11])
    for group in hmm.packed(at):
        logs, _ = hmm.forward(model, seq, at[:-1][group], np.diff(at)[group])
        for i, log in zip(group, logs, strict=True):
            s, total = seq[at[i] : at[i + 1]], 0.0
            for path in itertools.product(range(3), repeat=len(s)):
                p = model.start[path[0]] * model.emit[path[0], s[0]]
                for a, b, o in zip(path, path[1:], s[1:], strict=False):
                    p *= model.move[a, b] * model.emit[b, o]
                total += p
            assert math.isclose(log, math.log(total), rel_tol=1e-9)


def test_baum_welch_never_falls():
    rng = np.random.default_rng(1)
    seq, at = np.concatenate([rng.integers(0, 10, 200), rng.integers(10, 20, 200)]).astype(np.int32), np.arange(0, 401, 20)
    model, last = hmm.Model.first(2, 20), -math.inf
    for _ in range(8):
        s, m, e, log = hmm.expected(model, seq, at)
        assert math.isclose(e.sum(), 400) and math.isclose(s.sum(), 20) and math.isclose(m.sum(), 380)
        assert log >= last - 1e-3
        last, model = log, hmm.updated(model, s, m, e, prior=1e-6)


def test_media_round_trip(spark):
    rows = documents()
    got = media.text_media(frame(spark, rows), with_media=True).collect()
    import hashlib

    want = Counter()
    for d, t, *_ in rows:
        raw = (t or "").encode()
        pad = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        want[d, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    for r in got:
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and len(r["media"]) == r["media_bytes"]
    by_text = {}
    for r in got:
        assert by_text.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    pcm = media.stored_pcm(spark.createDataFrame([(bytes(got[0]["media"]),), (None,), (b"junk",)], "media binary"), to=16000).collect()
    assert len(pcm[0]["pcm"]) == 4 * got[0]["payload_bytes"] and pcm[1]["pcm"] is None and pcm[2]["pcm"] is None
    assert media.text_media(frame(spark, [])).count() == 0


def test_companding_tables():
    assert [int(media.MU[x]) for x in (0x00, 0x7F, 0x80, 0xFF)] == [-32124, 0, 32124, 0]
    assert [int(media.A[x]) for x in (0x55, 0xD5, 0x2A, 0xAA)] == [-8, 8, -32256, 32256]
    assert len(set(media.A.tolist())) == 256 and (media.MU[:128] <= 0).all()


def test_adpcm_follows_the_signal():
    t = np.arange(4000)
    wave = (8000 * np.sin(t / 20) + 2000 * np.sin(t / 7)).astype(np.int16)
    data = media.adpcm_encode(wave, 256)
    back = media.adpcm_decode(data, 256)[: len(wave)]
    assert len(data) * 3 < len(wave) * 2 and np.abs(back.astype(int) - wave)[64:].mean() < 300
    assert len(media.adpcm_decode(b"", 256)) == 0
    samples, rate = media.pcm_of(media.wave(data, media.IMA_ADPCM, block=256, bits=4))
    assert rate == 8000 and (samples[: len(wave)] == back).all()
    assert len(media.resampled(wave, 8000, 16000)) == 8000 and (media.resampled(wave, 8000, 16000)[::2] == wave).all()


def insults(n=1500):
    rng, rows, labels = random.Random(9), [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        text = prose(rng, rng.randint(3, 50)).split()
        if toxic:
            text.insert(rng.randrange(len(text) + 1), rng.choice(["snarl", "snarly", "venom!", "VENOM", "venomous"]))
        rows.append((i, " ".join(text), rng.choice(["en", None]), "a", 1, 7, "x", "y", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = insults()
    truth = {d: t for d, _, t in labels}
    docs, marks = frame(spark, rows + documents()[-9:]), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(docs, *toxicity.fit(docs, marks.where(~toxicity.held_out()), words=4096)).collect()
    assert len(got) == len(rows) + 9 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    out = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] < 1500 and r["doc_id"] != 6]
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in out) / len(out) > 0.95


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = frame(spark)
    assert toxicity.toxicity(docs, *toxicity.fit(docs, none, words=64)).count() == docs.count()
    assert toxicity.toxicity(frame(spark, []), *toxicity.fit(docs, none, words=64)).count() == 0


def test_toxicity_learns_from_every_label(spark):
    """The 10 000 ids with the least hash are all harmless; what is toxic is only in the others."""
    ids = [r["doc_id"] for r in spark.range(11_000).select(F.col("id").alias("doc_id")).orderBy(F.xxhash64("id"), "id").collect()]
    rng, rows, labels = random.Random(3), [], []
    for i, d in enumerate(ids):
        toxic = i >= 10_000 and i % 2 == 0
        rows.append((d, prose(rng, 3) + (" venom" if toxic else ""), "en" if i < 10_000 else "de"))
        labels.append((d, 1, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    net, cuts = toxicity.fit(docs, marks, words=1024, epochs=2, block=3000)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, net, cuts).collect()}
    assert sum(got[d] == t for d, _, t in labels) / len(labels) > 0.999 and list(cuts) == ["de"]


def test_toxicity_rows_of_labels(spark):
    """Every row of a labelled id counts, whichever way the labels are joined, and the counts are those of all training texts."""
    docs = frame(spark)
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(0, 50, 2)] + [(3, 1, 0), (3, 1, 1), (5, 1, None), (6, 1, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    toxic = {**{i: i % 2 for i in range(0, 50, 2)}, 3: 1, 6: 1}
    want = Counter((t, lang, toxic[d]) for d, t, lang, *_ in documents() if d in toxic)
    for few in (0, 100):
        assert Counter((r["text"], r["lang"], r["toxic"]) for r in toxicity.labelled(docs, marks, few).collect()) == want
    many = toxicity.labelled(docs, marks)
    many = many.unionAll(many.limit(1)).unionAll(many.where("false"))
    seen = np.zeros(2 * 256 + 1, np.int64)
    for r in many.collect():
        pairs, ids, _ = toxicity.word_ids(pa.array([r["text"]]), 256)
        seen[np.unique(pairs[ids])] += 1
    for parts in (1, 5, 70):
        blocks = toxicity.in_blocks(many, parts, 256, 4)
        assert blocks.selectExpr("sum(length(labels) / 8)").first()[0] == many.count()
        assert (toxicity.hashes_seen(blocks, parts, 256) == seen).all()


def test_toxicity_is_the_same_however_rows_lie(spark):
    rows, labels = insults(600)
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    one, two = (toxicity.fit(d, marks, words=512, epochs=2, block=100) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one[1] == two[1] and (one[0].embed == two[0].embed).all() and (one[0].scale, one[0].offset) == (two[0].scale, two[0].offset)


def test_averages_of_blocks():
    part = lambda idx, weight, val: (np.array(idx, np.int32).tobytes(), np.array(weight, np.int64).tobytes(), np.array(val, np.float32).tobytes())
    idx, n, val = toxicity.averaged([part([3, 1], [1, 2], [[4, 0], [1, 1]]), part([3], [3], [[8, 4]])])
    assert idx.tolist() == [1, 3] and n.tolist() == [2, 4] and val.tolist() == [[1, 1], [7, 3]]


def test_pooling_equals_plain_convolution():
    net = toxicity.Net.first(50, 4, (1, 2, 3), 3)
    texts = pa.array(["a b c d e", "", "x", "one two", None, "b b b b b b b b"])
    pairs, ids, at = toxicity.word_ids(texts, 50)
    got = toxicity.margins(net, toxicity.tables_of(net, pairs), ids, at)
    for i in range(len(at) - 1):
        e = net.embed[pairs[ids[at[i] : at[i + 1]]]].sum(1) if at[i + 1] > at[i] else np.zeros((1, 4))
        e = np.concatenate([e, np.zeros((3, 4))])
        n = max(1, at[i + 1] - at[i])
        h = np.concatenate([np.max([sum(e[t + j] @ w[j] for j in range(len(w))) for t in range(n)], axis=0) + b for w, b in zip(net.filters, net.bias, strict=True)])
        assert math.isclose(got[i], float(np.maximum(h, 0) @ net.out + net.shift), rel_tol=1e-4, abs_tol=1e-4)


def test_quality(spark):
    rng, rows, labels = random.Random(2), [], []
    for i in range(900):
        good = rng.random() < 0.7
        text = prose(rng, rng.randint(5, 60))
        if not good:
            text = "\n".join(w.upper() + rng.choice(["!!", "###", "%%%"]) for w in text.split())
        rows.append((i, text, "en", "a" if good or rng.random() < 0.5 else "b", len(text), 7, "x", "y", 1))
        if i % 2:
            labels.append((i, int(good), 0))
        rows[-1] = (*rows[-1][:8], int(good))
    docs = frame(spark, rows + documents()[-9:])
    model = quality.cotrain(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = quality.judged(docs, model)
    assert got.columns == [*docs.columns, "gw_score", "gw_text_score", "gw_meta_score", "gw_keep"] and got.count() == len(rows) + 9
    unseen = [r for r in got.where("doc_id % 2 = 0 and doc_id < 900").collect() if r["size"] == 7 and r["doc_id"] != 6]
    assert sum(r["gw_keep"] == bool(r["label"]) for r in unseen) / len(unseen) > 0.97


def test_quality_without_labels(spark):
    docs, none = frame(spark), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = quality.judged(docs, quality.cotrain(docs, none))
    assert got.where("gw_keep").count() == docs.count() and got.where(F.col("gw_score").isNotNull()).count() == 0
    assert quality.judged(frame(spark, []), None).count() == 0


def test_limits_are_measured():
    odds = np.array([5.0, 4.0, 3.0, 2.0, 1.0, -1.0, -2.0, -3.0])
    assert quality.limits(odds, np.array([1, 1, 1, 1, 0, 0, 0, 0]), 0.8) == (1.0, 2.0)
    assert quality.limits(odds, np.array([1, 0, 1, 0, 1, 0, 1, 0]), 0.9) == (-math.inf, math.inf)
    assert quality.limits(np.zeros(0), np.zeros(0), 0.9) == (-math.inf, math.inf)
    many, good = np.arange(1000.0), np.arange(1000) >= 300
    low, high = quality.limits(many, good.astype(float), 0.99)
    assert low >= 299 and high <= 300 and (good[many >= high].sum() + 1) / ((many >= high).sum() + 2) >= 0.99
