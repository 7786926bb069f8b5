import itertools
import math
from collections import Counter

import numpy as np
import xxhash

from geoweft.llm import hmm

from .data import documents, frame
from .test_models import held, tokens


def test_segments_give_the_counts_of_whole_chains():
    rng = np.random.default_rng(3)
    seq, at = rng.integers(0, 12, 700).astype(np.int32), np.array([0, 1, 1, 40, 41, 300, 700])
    model = hmm.Model.first(3, 12)
    model.move, model.start = rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(3))
    whole = hmm.expected(model, seq, at, segment=10_000)
    assert math.isclose(whole[0].sum(), 5) and math.isclose(whole[1].sum(), 695) and math.isclose(whole[2].sum(), 700)
    for segment in (1, 7, 40, 399):
        for a, b in zip(hmm.expected(model, seq, at, segment), whole, strict=True):
            assert np.allclose(a, b, rtol=1e-9, atol=1e-12)


def test_counts_equal_sums_over_paths():
    rng = np.random.default_rng(5)
    model, seq = hmm.Model.first(2, 3), np.array([0, 3, 1, 2, 2], np.int32)
    model.move, model.start = rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(2))
    starts, moves, emits, total = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 4)), 0.0
    for path in itertools.product(range(2), repeat=len(seq)):
        p = model.start[path[0]] * np.prod([model.emit[s, o] for s, o in zip(path, seq, strict=True)]) * np.prod([model.move[a, b] for a, b in itertools.pairwise(path)])
        total += p
        starts[path[0]] += p
        for a, b in itertools.pairwise(path):
            moves[a, b] += p
        for s, o in zip(path, seq, strict=True):
            emits[s, o] += p
    got = hmm.expected(model, seq, np.array([0, len(seq)]), segment=2)
    for a, b in zip(got, (starts / total, moves / total, emits / total, math.log(total)), strict=True):
        assert np.allclose(a, b)


def test_scores_equal_a_plain_computation(spark):
    """Every step again in plain Python: word counts, classes, forward recursion, words within their class; rare words and held-out ones too."""
    rows = documents(80) + [(7000 + i, " ".join(["onlyheldout"] * 30), "en", "a", 1, 7, "x", "y", 1) for i in range(60) if held(7000 + i, 7, 2)]
    docs = frame(spark, rows).select("doc_id", "text", hmm.held_out().alias("held_out"))
    for head in (1 << 18, 3):
        lang = hmm.train(docs, states=3, classes=16, rounds=2, head=head)
        count = Counter(w for d, t, *_ in rows if not held(d, 7, 2) for w in tokens(t))
        klass = lambda w: int(np.uint64(xxhash.xxh64_intdigest(w, 42)).view(np.int64) % 16)
        of = {k: [c for w, c in count.items() if klass(w) == k] for k in range(16)}
        m, want = lang.model, Counter()
        for d, t, *_ in rows:
            ts, alpha, log = tokens(t), None, 0.0
            for o in [*[klass(w) for w in ts], 16]:
                alpha = [(m.start[s] if alpha is None else sum(alpha[r] * m.move[r, s] for r in range(3))) * m.emit[s, o] for s in range(3)]
                log += math.log10(sum(alpha))
                alpha = [a / sum(alpha) for a in alpha]
            log += sum(math.log10((count[w] + 0.5) / (sum(of[klass(w)]) + 0.5 * (len(of[klass(w)]) + 1))) for w in ts)
            want[d, round(log, 6)] += 1
        assert Counter((r["doc_id"], round(r["score"], 6)) for r in hmm.scored(docs, lang).collect()) == want


def test_rounds_see_every_text_and_never_fall(spark):
    lang = hmm.train(frame(spark).select("doc_id", "text", hmm.held_out().alias("held_out")), states=3, classes=32, rounds=6)
    assert len(lang.model.logs) == 6 and lang.model.logs[-1] > lang.model.logs[0]
