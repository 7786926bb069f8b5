"""Quality classifier by co-training: one logistic model sees the text's content, the other only the page's metadata.

The content view has shares of character classes, word outlines, repetition and hashed words; no feature of it is a length, which is
left to the metadata. The metadata view has source, language and stated length.

Both start from labelled rows. In each round, each view labels the unlabelled documents it is confident about, and the other view takes
Newton steps on its labelled rows plus these. Every document takes part: tasks send sums of gradients and curvatures (as large as the
model, whatever the corpus). What a view is confident about is measured, not assumed: beyond its limit for a class, at least `sure` of the
labelled rows that were kept out of training have that class; a view without such a limit hands on nothing of the class. A class's
pseudo-labels together weigh at most `share` of its true labels. At the end, both
views' log-odds are calibrated and combined by a logistic fit on labelled rows that were kept out of training.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import dropped, flat_words, slices, summed, written

SHAPES, WORDS, SOURCES, LANGS, LENGTHS = 16, 96, 32, 8, 10
#: Classes of bytes: lower case, upper case, digit, space, line end, | and >, other ASCII, beyond ASCII.
BYTE_CLASS = np.array([0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in (32, 9) else 4 if b in (10, 13) else 5 if b in (124, 62) else 7 if b > 127 else 6 for b in range(256)], np.uint8)
META_DIM = SOURCES + LANGS + LENGTHS


def shapes_of(words: pa.Array) -> np.ndarray:
    """A bucket for each word's outline: runs of letters, digits and signs count as one, signs as their first."""
    if not len(words):
        return np.zeros(0, np.int64)
    for pattern, to in ((r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), (r"\d+", "0"), (r"([^aA0])[^aA0]*", r"\1")):
        words = pc.replace_substring_regex(words, pattern=pattern, replacement=to)
    coded = words.dictionary_encode()
    return np.array([zlib.crc32(w.encode()) % SHAPES for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of content features for each text (nulls: empty)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    row = np.repeat(np.arange(n, dtype=np.int32) * 8, size)
    chars = np.bincount(row + BYTE_CLASS[raw], minlength=8 * n).reshape(n, 8) / np.maximum(size, 1)[:, None]
    flat, at = flat_words(texts, lower=False)
    coded = flat.dictionary_encode()
    words, idx, count = coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.diff(at)
    of = np.repeat(np.arange(n), count)
    u, some = max(len(words), 1), np.maximum(count, 1)
    pairs, times = np.unique(of * u + idx, return_counts=True)
    distinct = np.bincount(pairs // u, minlength=n) / some
    top = np.zeros(n)
    np.maximum.at(top, pairs // u, times)
    twice = idx[:-1] * u + idx[1:] if len(idx) else idx
    inside = of[:-1] == of[1:] if len(idx) else np.zeros(0, bool)
    key = np.sort((of[:-1][inside] << 44) ^ ((twice[inside] * np.int64(0x9E3779B97F4A7C1)) & ((1 << 44) - 1))) if len(idx) else idx
    fresh = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    bigrams = np.bincount(fresh >> 44, minlength=n) / np.maximum(count - 1, 1)
    lengths = pc.utf8_length(words).to_numpy().astype(np.float64)
    alpha = pc.utf8_is_alnum(pc.utf8_slice_codeunits(words, -1)).to_numpy(zero_copy_only=False).astype(np.float64)
    mean = lambda x: np.bincount(of, x[idx], n) / some if len(idx) else np.zeros(n)
    share = lambda kind, many: np.bincount(of * many + kind[idx], minlength=n * many).reshape(n, many) / some[:, None] if len(idx) else np.zeros((n, many))
    bucket = np.array([zlib.crc32(w.encode()) % WORDS for w in pc.ascii_lower(words).to_pylist()], np.int64)
    average = mean(lengths)
    rest = [average, np.sqrt(np.maximum(mean(lengths**2) - average**2, 0)), distinct, top / some, bigrams, mean(alpha)]
    return np.concatenate([chars, np.stack(rest, 1), share(shapes_of(words), SHAPES), np.sqrt(share(bucket, WORDS))], 1)


def meta_features(source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """One row of metadata features: hashed source and language (nulls have a bucket, too) and the stated length on a log scale."""
    out, row = np.zeros((len(source), META_DIM)), np.arange(len(source))
    for values, sign, at, many in ((source, "s", 0, SOURCES), (lang, "l", SOURCES, LANGS)):
        coded = values.dictionary_encode(null_encoding="encode")
        bucket = np.array([zlib.crc32(f"{sign}{x}".encode()) % many for x in coded.dictionary.to_pylist()], np.int64)
        if len(row):
            out[row, at + bucket[coded.indices.to_numpy()]] = 1
    n = pc.fill_null(n_chars.cast(pa.float64()), -1.0).to_numpy()
    out[row, SOURCES + LANGS + np.where(n < 0, 0, np.minimum(LENGTHS - 1, 1 + np.log2(np.maximum(n, 0) + 1).astype(np.int64) // 2))] = 1
    return out


@dataclass
class View:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the constant

    def rows(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, np.ones((len(x), 1))], 1)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.rows(x) @ self.weights


def chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def newton(w: np.ndarray, gradient: np.ndarray, curve: np.ndarray, ridge: float) -> np.ndarray:
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    step = np.linalg.solve(curve + np.diag(keep), gradient - keep * w)
    return w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))


def derivatives(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = chance(x @ w)
    return x.T @ (y - p), (x * (p * (1 - p))[:, None]).T @ x


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 15) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        w = newton(w, *derivatives(x, y, w), ridge)
    return w


@dataclass
class Quality:
    views: tuple[View, View]
    combine: np.ndarray  # weights of both log-odds and a constant
    cut: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.views[0].odds(text), self.views[1].odds(meta)
        z = np.stack([np.clip(a, -15, 15), np.clip(b, -15, 15), np.ones(len(a))], 1) @ self.combine
        return chance(z), chance(a), chance(b)


FEATURES = "doc_id bigint, text_key bigint, a array<float>, b array<float>"


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (hash of the text) and both views' features of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                text = text_features(b.column("text")).astype(np.float32)
                meta = meta_features(*[b.column(c) for c in ("source", "lang", "n_chars")]).astype(np.float32)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (text, meta)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("text_key"), *lists], names=["doc_id", "text_key", "a", "b"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("double").alias("n_chars")).mapInArrow(run, FEATURES)


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


def limits(odds: np.ndarray, y: np.ndarray, sure: float) -> tuple[float, float]:
    """Log-odds up to which a row counts as bad for sure, and from which as good: the widest ranges whose rows, with one of each class
    added, are of the class in a share of `sure`; infinite if there is none."""
    out = []
    for z, hit in ((-odds, y == 0), (odds, y == 1)):
        order = np.argsort(-z, kind="stable")
        share = (np.cumsum(hit[order]) + 1) / (np.arange(1, len(z) + 1) + 2)
        last = np.flatnonzero((share >= sure) & np.append(z[order][1:] < z[order][:-1], True)) if len(z) else np.zeros(0, int)
        out.append(float(z[order][last[-1]]) if len(last) else np.inf)
    return -out[0], out[1]


def pseudo_sums(table: DataFrame, views: tuple[View, View], sides: list[tuple[float, float]]) -> list[list[tuple[float, np.ndarray, np.ndarray]]]:
    """For each view and class: count, gradient and curvature over the unlabelled documents of which the other view is sure."""
    dims = [len(v.weights) for v in views]
    each = [1 + d + d * d for d in dims]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * sum(each))
        for b in batches:
            if not b.num_rows:
                continue
            x = [v.rows(matrix(b.column(c))) for v, c in zip(views, "ab", strict=True)]
            odds = [m @ v.weights for m, v in zip(x, views, strict=True)]
            at = 0
            for i in (0, 1):
                for y in (0, 1):
                    who = odds[1 - i] >= sides[1 - i][1] if y else odds[1 - i] <= sides[1 - i][0]
                    g, h = derivatives(x[i][who], np.full(int(who.sum()), float(y)), views[i].weights)
                    total[at : at + each[i]] += np.concatenate([[who.sum()], g, h.ravel()])
                    at += each[i]
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], names=["idx", "val"])

    got = summed(table.mapInArrow(run, "idx int, val double"))
    flat = np.zeros(2 * sum(each))
    flat[list(got)] = list(got.values())
    out, at = [], 0
    for i in (0, 1):
        row = []
        for _ in (0, 1):
            part = flat[at : at + each[i]]
            row.append((part[0], part[1 : 1 + dims[i]], part[1 + dims[i] :].reshape(dims[i], dims[i])))
            at += each[i]
        out.append(row)
    return out


def cotrain(docs: DataFrame, labels: DataFrame, **options) -> Quality | None:
    """As cotrained, on docs (doc_id, text, source, lang, n_chars)."""
    table = written(feature_table(docs), "quality-features")
    model = cotrained(table, labels, **options)
    dropped(table)
    return model


def cotrained(table: DataFrame, labels: DataFrame, rows: int = 8000, rounds: int = 2, steps: int = 2, sure: float = 0.97, share: float = 0.5, least_recall: float = 0.995) -> Quality | None:
    """Train on a written feature_table and labels (doc_id, quality), of which at most `rows` ids, by least hash, are used.

    Of an id's rows, the one with the least text hash counts. A quarter of these calibrates only. The cut keeps at least `least_recall` of
    the good calibration rows, and is 0.5 at most. Without labels of both classes there is nothing to learn: None. Labels that disagree
    about an id count as good.
    """
    chosen = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    got = table.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text_key", "a", "b", "y")).alias("r"))
    got = got.select("r.a", "r.b", "r.y", F.xxhash64("doc_id").alias("h")).toArrow().sort_by("h")
    y = got.column("y").to_numpy().astype(np.float64)
    if not got.num_rows or y.min() == y.max():
        return None
    x = [matrix(got.column(c)) for c in "ab"]
    apart = got.column("h").to_numpy() % 4 == 0
    if any(len(np.unique(y[m])) < 2 for m in (apart, ~apart)):
        apart = np.zeros(len(y), bool)
    train = ~apart
    views = []
    for m in x:
        v = View(m[train].mean(0), m[train].std(0) + 1e-3, np.zeros(m.shape[1] + 1))
        v.weights = fitted(v.rows(m[train]), y[train])
        views.append(v)
    unlabelled = table.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti").select("a", "b")
    for _ in range(rounds):
        for _ in range(steps):
            sums = pseudo_sums(unlabelled, (views[0], views[1]), [limits(v.odds(m[apart]), y[apart], sure) for v, m in zip(views, x, strict=True)])
            for i, v in enumerate(views):
                g, h = derivatives(v.rows(x[i][train]), y[train], v.weights)
                for cls, (n, pg, ph) in enumerate(sums[i]):
                    weight = min(1.0, share * float((y[train] == cls).sum()) / n) if n else 0.0
                    g, h = g + weight * pg, h + weight * ph
                v.weights = newton(v.weights, g, h, 1.0)
    test = apart if apart.any() else train
    odds = np.stack([np.clip(v.odds(m[test]), -15, 15) for v, m in zip(views, x, strict=True)] + [np.ones(int(test.sum()))], 1)
    combine = fitted(odds, y[test], ridge=0.1)
    p = np.sort(chance(odds @ combine)[y[test] == 1])
    cut = min(0.5, float(p[int(len(p) * (1 - least_recall))]))
    return Quality((views[0], views[1]), combine, cut)


ADDED = ["gw_score", "gw_text_score", "gw_meta_score", "gw_keep"]


def unjudged(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.lit(None).cast("double") for c in ADDED[:3]}).withColumn("gw_keep", F.lit(True))


def scored_table(table: DataFrame, model: Quality | None) -> DataFrame:
    """doc_id and what judged() adds, from a feature_table, so that no text is read again."""
    if model is None:
        return unjudged(table.select("doc_id"))
    sent = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                scores = sent.value.score(matrix(b.column("a")), matrix(b.column("b")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(s) for s in scores], pa.array(scores[0] >= sent.value.cut)], names=["doc_id", *ADDED])

    return table.select("doc_id", "a", "b").mapInArrow(run, "doc_id bigint, gw_score double, gw_text_score double, gw_meta_score double, gw_keep boolean")


def judged(docs: DataFrame, model: Quality | None) -> DataFrame:
    """All rows and columns of docs with gw_score (chance of good quality), gw_text_score, gw_meta_score and gw_keep.

    Null texts count as empty; null metadata has a bucket of its own. Without a model every score is null and every row is kept.
    Repeated rows get the same scores. Columns of docs with the added names are replaced; all others keep their names and values.
    """
    docs = docs.drop(*ADDED)
    if model is None:
        return unjudged(docs)
    schema = StructType(list(docs.schema.fields))
    for c in ADDED[:3]:
        schema = schema.add(c, "double")
    schema = schema.add("gw_keep", "boolean")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                meta = meta_features(*[b.column(c).cast(pa.string()) for c in ("source", "lang")], b.column("n_chars"))
                scores = sent.value.score(text_features(b.column("text")), meta)
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(s) for s in scores], pa.array(scores[0] >= sent.value.cut)], names=[*b.schema.names, *ADDED])

    return docs.mapInArrow(run, schema)
