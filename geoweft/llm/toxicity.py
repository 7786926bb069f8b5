"""Toxicity: a convolutional text classifier trained in numpy.

Words are hashed to embeddings, each the sum of one for the whole word and one for its first four letters, so that forms of a word share
what was learned; hashes that fewer than `least_texts` training texts hold stay zero. Filters of several widths slide over them; each filter keeps its maximum over the whole text; a
logistic layer scores the maxima. As a filter is linear in the embeddings, each word's contribution at each offset is tabled
before scoring, so a text costs a few table look-ups a word. A scale and shift learned on rows kept out of training calibrate
the score, and a threshold for each language is reported beside it: the one where F1 is best on the language's rows among these, drawn
towards the common 0.5 as far as they hold few toxic rows.

Every labelled row is learned from. They are dealt into blocks of some thousand texts; in each epoch tasks train the same net on one
block each, and the nets are averaged: filters and the logistic layer by the blocks' texts, each embedding by the texts that hold its hash.
"""

from __future__ import annotations

import copy
import string
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, dropped, flat_words, numbered, slices, written

TOKENS = 200_000  # of one step in memory
BLOCK_BYTES = 32 << 20  # of text in a block, about
CHUNKS = 32  # parts of the embeddings that are averaged apart
FEW = 1 << 20  # labelled ids that are broadcast; more are joined by shuffle
TOGETHER = 64  # blocks whose sums meet in one step
STEP = 1000  # steps of calibration for each unit of the log-odds
PRIOR = 10  # toxic rows that the common threshold counts for beside a language's own


@dataclass
class Net:
    embed: np.ndarray  # hashes x dims; row 0 is padding
    filters: list[np.ndarray]  # for each width: width x dims x filters
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float
    scale: float = 1.0
    offset: float = 0.0
    moments: list[np.ndarray] = field(default_factory=list)  # Adam's: first and second of each dense parameter, and the steps
    size: np.ndarray | None = None  # summed squares of each embedding's gradients

    @staticmethod
    def first(words: int, dims: int, widths: tuple[int, ...], filters: int, seed: int = 5) -> Net:
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.3, (2 * words + 1, dims)).astype(np.float32)
        embed[0] = 0
        w = [rng.normal(0, 1 / np.sqrt(k * dims), (k, dims, filters)).astype(np.float32) for k in widths]
        return Net(embed, w, [np.zeros(filters, np.float32) for _ in widths], rng.normal(0, 0.3, filters * len(widths)).astype(np.float32), -2.0)


def word_ids(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each distinct word (whole, first letters; row 0 is padding), all words as indices of these, and texts' first positions.

    Punctuation around a word does not count. Whole words have ids 1..words, beginnings words+1..2 words.
    """
    flat, at = flat_words(texts)
    if not len(flat):
        return np.zeros((1, 2), np.int32), np.zeros(0, np.int32), at
    coded = flat.dictionary_encode()
    bare = pc.utf8_trim(coded.dictionary, characters=string.punctuation).to_pylist()
    digest = xxhash.xxh64_intdigest
    pairs = np.zeros((len(bare) + 1, 2), np.int32)
    pairs[1:, 0] = np.fromiter((digest(w, 42) % words + 1 for w in bare), np.int32, len(bare))
    pairs[1:, 1] = np.fromiter((digest(w[:4], 43) % words + 1 + words for w in bare), np.int32, len(bare))
    return pairs, coded.indices.to_numpy() + 1, at


def padded(ids: np.ndarray, at: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids with `pad` zeros after every text (one more for an empty one), texts' starts, and their window counts (1 at least)."""
    n = np.diff(at)
    count = np.maximum(n, 1)
    starts = np.concatenate(([0], np.cumsum(count + pad)))
    out = np.zeros(starts[-1], np.int32)
    out[np.repeat(starts[:-1] - at[:-1], n) + np.arange(len(ids))] = ids
    return out, starts[:-1], count


def maxima(tables: list[list[np.ndarray]], ids: np.ndarray, starts: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """For each width, each filter's maximum over each text's windows."""
    edges = np.stack([starts, starts + count], 1).ravel()
    out = []
    for t in tables:
        n = len(ids) - len(t) + 1
        total = t[0][ids[:n]]
        for j in range(1, len(t)):
            total = total + t[j][ids[j : j + n]]
        ends = edges if edges[-1] < n else edges[:-1]
        out.append(np.maximum.reduceat(total, ends, axis=0)[::2])
    return out


def tables_of(net: Net, pairs: np.ndarray) -> list[list[np.ndarray]]:
    embed = net.embed[pairs].sum(1)
    return [[embed @ w[j] for j in range(len(w))] for w in net.filters]


def margins(net: Net, tables: list[list[np.ndarray]], ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Uncalibrated log-odds of the texts, some tokens at a time."""
    pad, out, low = max(len(w) for w in net.filters), np.zeros(len(at) - 1), 0
    while low < len(out):
        high = max(low + 1, int(np.searchsorted(at, at[low] + TOKENS, side="right")) - 1)
        part = padded(ids[at[low] : at[high]], at[low : high + 1] - at[low], pad)
        h = np.concatenate([np.maximum(m + b, 0) for m, b in zip(maxima(tables, *part), net.bias, strict=True)], 1)
        out[low:high] = h @ net.out + net.shift
        low = high
    return out


def dense_of(net: Net) -> list[np.ndarray]:
    """All parameters but the embeddings."""
    return [net.out, np.array([net.shift], np.float32), *net.filters, *net.bias]


def with_dense(net: Net, flat: np.ndarray) -> None:
    """Set the parameters, their moments and the steps from one vector, as flat_of gives it."""
    shapes, got = [x.shape for x in dense_of(net)], []
    ends = np.cumsum([int(np.prod(x)) for x in shapes] * 3)
    for x, shape in zip(np.split(flat[:-1], ends[:-1]), shapes * 3, strict=True):
        got.append(x.reshape(shape).astype(np.float32))
    k = len(net.filters)
    net.out, net.shift, net.filters, net.bias = got[0], float(got[1][0]), got[2 : 2 + k], got[2 + k : 2 + 2 * k]
    net.moments = [*got[len(shapes) :], flat[-1:].copy()]


def flat_of(net: Net) -> np.ndarray:
    return np.concatenate([x.ravel().astype(np.float64) for x in (*dense_of(net), *net.moments)])


def started(net: Net) -> Net:
    """The net before its first step."""
    net.moments = [*[np.zeros_like(x) for x in dense_of(net) * 2], np.zeros(1)]
    net.size = np.zeros(len(net.embed), np.float32)
    return net


def trained(net: Net, used_hash: np.ndarray, rate_of: float, epoch: int, rng: np.random.Generator, pairs: np.ndarray, ids: np.ndarray, at: np.ndarray, labels: np.ndarray) -> Net:
    """The net after one epoch over these texts: minibatch Adam on the logistic loss; hashes that aren't used stay zero.

    Max pooling sends gradients only to each filter's best window, so a step touches few words.
    """
    net, pad, n = copy.deepcopy(net), max(len(w) for w in net.filters), len(labels)
    dense = len(dense_of(net))
    rate = 0.02 * 0.5**epoch

    def adam(i: int, value: np.ndarray, grad: np.ndarray) -> np.ndarray:
        m, v, t = 0.9 * net.moments[i] + 0.1 * grad, 0.99 * net.moments[dense + i] + 0.01 * grad * grad, net.moments[-1][0]
        net.moments[i], net.moments[dense + i] = m, v
        return value - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    for rows in minibatches(rng.permutation(n), np.diff(at)):
        seq = np.concatenate([ids[at[r] : at[r + 1]] for r in rows])
        sub = np.concatenate(([0], np.cumsum(at[rows + 1] - at[rows])))
        tok, starts, count = padded(seq, sub, pad)
        used, local = np.unique(tok, return_inverse=True)
        both = pairs[used]
        emb = net.embed[both].sum(1)
        y, row_of = labels[rows], np.repeat(np.arange(len(rows)), count)
        hidden, best = [], []
        edges = np.stack([starts, starts + count], 1).ravel()
        for w, b in zip(net.filters, net.bias, strict=True):
            k, m = len(w), len(tok) - len(w) + 1
            total = (emb @ w[0]).take(local[:m], axis=0)
            for j in range(1, k):
                total += (emb @ w[j]).take(local[j : j + m], axis=0)
            top = np.maximum.reduceat(total, edges if edges[-1] < m else edges[:-1], axis=0)[::2]
            windows = np.repeat(starts - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            hit, f = np.divmod(np.flatnonzero(total.take(windows, axis=0) == top.take(row_of, axis=0)), top.shape[1])
            where = np.zeros(top.shape, np.int64)
            where[row_of[hit], f] = windows[hit]
            hidden.append(top + b)
            best.append(where)
        h = np.concatenate(hidden, 1)
        act = np.maximum(h, 0)
        p = 1 / (1 + np.exp(-np.clip(act @ net.out + net.shift, -30, 30)))
        d = (p - y) * np.where(y == 1, rate_of, 1.0) / len(rows)
        back = (d[:, None] * net.out * (h > 0)).astype(np.float32)
        net.moments[-1] = net.moments[-1] + 1
        net.out = adam(0, net.out, (act.T @ d).astype(np.float32) + 1e-4 * net.out)
        net.shift = float(adam(1, np.array([net.shift]), np.array([d.sum()]))[0])
        grad_e, at_f = np.zeros_like(emb), 0
        for i, where in enumerate(best):
            g = back[:, at_f : at_f + where.shape[1]]
            at_f += where.shape[1]
            grad_w = np.zeros_like(net.filters[i])
            for j in range(len(grad_w)):
                word = local[where + j]
                grad_w[j] = np.einsum("rf,rfd->df", g, emb[word])
                grad_e += scattered(len(emb), word.ravel(), (g[:, :, None] * net.filters[i][j].T[None]).reshape(-1, emb.shape[1]))
            net.filters[i] = adam(2 + i, net.filters[i], grad_w)
            net.bias[i] = adam(2 + len(best) + i, net.bias[i], g.sum(0))
        for side in (0, 1):
            rows_e, back_e = np.unique(both[:, side], return_inverse=True)
            g = scattered(len(rows_e), back_e, grad_e)
            net.size[rows_e] += (g * g).mean(1)
            net.embed[rows_e] -= used_hash[rows_e, None] * (0.05 * g / (np.sqrt(net.size[rows_e])[:, None] + 1e-6))
        net.embed[0] = 0
    return net


def scattered(n: int, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of the rows at each of n places."""
    dims = rows.shape[1]
    return np.bincount((at[:, None] * dims + np.arange(dims)).ravel(), rows.ravel(), n * dims).reshape(n, dims).astype(np.float32)


def minibatches(order: np.ndarray, words: np.ndarray, most: int = 128) -> Iterator[np.ndarray]:
    """The texts in this order, so many at a time, or fewer once they have TOKENS words."""
    low, have = 0, 0
    for i, n in enumerate(words[order].tolist()):
        have += n
        if i + 1 - low == most or have >= TOKENS:
            yield order[low : i + 1]
            low, have = i + 1, 0
    if low < len(order):
        yield order[low:]


def calibrated(net: Net, margin: np.ndarray, toxic: np.ndarray, rows: np.ndarray) -> None:
    """Scale and shift of the log-odds so that 0.5 is where F1 is best on these rows, and the slope is that of a logistic fit."""
    cut = best_cut(margin, toxic, rows)
    slope, z, n = 1.0, margin - cut, max(1, rows.sum())
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * z, -30, 30)))
        slope += np.clip((((toxic - rows * p) * z).sum() / n) / max((rows * p * (1 - p) * z * z).sum() / n, 1e-3), -0.5, 0.5)
        slope = float(np.clip(slope, 0.05, 20))
    net.scale, net.offset = slope, -slope * cut


def best_cut(score: np.ndarray, toxic: np.ndarray, rows: np.ndarray) -> float:
    """Halfway between neighbouring scores, where F1 is best, of so many toxic ones among so many rows at each score."""
    if not toxic.any():
        return float(score.max()) + 1.0 if len(score) else 0.0
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(toxic[order])
    f1 = 2 * hits / (np.cumsum(rows[order]) + toxic.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k]) - 0.5


def shrunk(cut: float, toxic: int) -> float:
    """A language's best threshold, weighted by its toxic rows against the common one."""
    return (toxic * min(max(cut, 0.0), 1.0) + PRIOR * 0.5) / (toxic + PRIOR)


def labelled(docs: DataFrame, labels: DataFrame, few: int = FEW) -> DataFrame:
    """h (hash of the id), text, lang and toxic of every row with a labelled id; an id's labels that disagree count as toxic."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.hint("broadcast" if marks.count() <= few else "shuffle_hash")
    return docs.select("doc_id", "text", "lang").join(marks, "doc_id").select(F.xxhash64("doc_id").alias("h"), "text", "lang", F.col("toxic").cast("long").alias("toxic"))


BLOCKS = "part bigint, nth bigint, seen binary, pairs binary, ids binary, at binary, labels binary"


def in_blocks(rows: DataFrame, parts: int, words: int, block: int) -> DataFrame:
    """All rows (h, text, toxic) as words' hashes: one row a block, beside the number of its texts that hold each hash.

    A part is one block; only repeated rows, which all go to one part, can fill several. The blocks do not depend on how rows were partitioned.
    """

    def encoded(part: int, nth: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        got = pa.Table.from_batches(held)
        pairs, ids, at = word_ids(got.column("text"), words)
        text_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
        seen = np.zeros(2 * words + 1, np.int32)
        for side in (0, 1):
            pair = np.unique(text_of * np.int64(len(seen)) + pairs[ids, side])
            seen += np.bincount(pair % len(seen), minlength=len(seen)).astype(np.int32)
        parts = [seen, pairs, ids.astype(np.int32), at, got.column("toxic").to_numpy().astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([nth]), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], names=[x.split()[0] for x in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, nth, n, size = [], -1, 0, 0, 0
        for b in (x for whole in batches for x in slices(whole)):
            part = b.column("part").to_numpy()
            for low, high in pairwise([0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]):
                if held and (part[low] != last or n >= 2 * block or size >= 2 * BLOCK_BYTES):
                    yield encoded(last, nth, held)
                    held, nth, n, size = [], nth + 1 if part[low] == last else 0, 0, 0
                held.append(b.take(pa.array(np.arange(low, high))))
                last, n, size = int(part[low]), n + high - low, size + held[-1].nbytes
        if held:
            yield encoded(last, nth, held)

    dealt = rows.select(F.pmod(F.xxhash64("h", "text"), F.lit(parts)).alias("part"), "h", "text", "toxic")
    dealt = dealt.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "h", F.xxhash64("text"), "toxic")
    return dealt.select("part", "text", "toxic").mapInArrow(run, BLOCKS)


SUMS = "chunk int, part bigint, nth bigint, idx binary, weight binary, val binary"


def chunked(part: int, nth: int, idx: np.ndarray, weight: np.ndarray, val: np.ndarray, dense: tuple[int, np.ndarray] | None = None) -> pa.RecordBatch:
    """Rows of SUMS: the hashes' weights and values by chunk, and the dense ones as chunk -1."""
    of = [np.flatnonzero(idx % CHUNKS == c) for c in range(CHUNKS)]
    got = [(c, idx[at], weight[at], val[at]) for c, at in enumerate(of) if len(at)] + ([] if dense is None else [(-1, np.zeros(1), np.array([dense[0]]), dense[1][None])])
    cols = [pa.array([x[0] for x in got], pa.int32()), pa.array([part] * len(got), pa.int64()), pa.array([nth] * len(got), pa.int64())]
    cols += [pa.array([x[i].astype(t).tobytes() for x in got], pa.binary()) for i, t in ((1, np.int32), (2, np.int64), (3, np.float32))]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SUMS.split(", ")])


def averaged(rows: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices, their summed weights and the weighted means of their values; rows are added in their order, in double precision."""
    idx, weight = [np.frombuffer(r[0], np.int32) for r in rows], [np.frombuffer(r[1], np.int64) for r in rows]
    u = np.unique(np.concatenate(idx))
    width = len(rows[0][2]) // 4 // len(idx[0])
    n, total = np.zeros(len(u), np.int64), np.zeros((len(u), width))
    for i, w, r in zip(idx, weight, rows, strict=True):
        at = np.searchsorted(u, i)
        n[at] += w
        total[at] += np.frombuffer(r[2], np.float32).reshape(-1, width) * w[:, None].astype(np.float64)
    return u, n, (total / n[:, None]).astype(np.float32)


def mean_of(sums: DataFrame, parts: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each chunk's weights and means over all blocks, some blocks at a time and always in the same order."""

    def run(key: tuple, got: pa.Table) -> pa.Table:
        got = got.sort_by([("part", "ascending"), ("nth", "ascending")])
        found = averaged(list(zip(*(got.column(x).to_pylist() for x in ("idx", "weight", "val")), strict=True)))
        row = [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([0], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in found]]
        return pa.table(row, names=[x.split()[0] for x in SUMS.split(", ")])

    while True:
        sums = sums.groupBy("chunk", F.floor(F.col("part") / TOGETHER).alias("many")).applyInArrow(run, SUMS)
        parts = -(-parts // TOGETHER)
        if parts == 1:
            return {r["chunk"]: averaged([(r["idx"], r["weight"], r["val"])]) for r in sums.collect()}


def hashes_seen(blocks: DataFrame, parts: int, words: int) -> np.ndarray:
    """The number of training texts that hold each hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                seen = np.frombuffer(r["seen"], np.int32)
                idx = np.flatnonzero(seen)
                yield chunked(r["part"], r["nth"], idx, seen[idx], np.zeros((len(idx), 1)))

    out = np.zeros(2 * words + 1)
    for idx, n, _ in mean_of(blocks.select("part", "nth", "seen").mapInArrow(run, SUMS), parts).values():
        out[idx] = n
    return out


def one_epoch(net: Net, used_hash: np.ndarray, rate_of: float, epoch: int, blocks: DataFrame, parts: int, seed: int) -> Net:
    """The average of the nets that are trained for an epoch on each block."""
    sent = blocks.sparkSession.sparkContext.broadcast((net, used_hash))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                seen, pairs, ids, at, labels = (np.frombuffer(r[k], t) for k, t in (("seen", np.int32), ("pairs", np.int32), ("ids", np.int32), ("at", np.int64), ("labels", np.int64)))
                rng = np.random.default_rng([seed, epoch, r["part"], r["nth"]])
                after = trained(*sent.value, rate_of, epoch, rng, pairs.reshape(-1, 2), ids, at, labels)
                idx = np.flatnonzero(seen * sent.value[1])
                val = np.concatenate([after.embed[idx], after.size[idx, None]], 1)
                yield chunked(r["part"], r["nth"], idx, seen[idx], val, (len(labels), flat_of(after)))

    got = mean_of(blocks.mapInArrow(run, SUMS), parts)
    sent.destroy()
    out = copy.deepcopy(net)
    with_dense(out, got.pop(-1)[2][0])
    for idx, _, val in got.values():
        out.embed[idx], out.size[idx] = val[:, :-1], val[:, -1]
    return out


def margins_seen(rows: DataFrame, net: Net) -> pa.Table:
    """lang, z (steps of the log-odds), toxic and rows: the number of these at each step, in a language."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole)):
            pairs, ids, at = word_ids(b.column("text"), len(sent.value.embed) // 2)
            z = np.rint(margins(sent.value, tables_of(sent.value, pairs), ids, at) * STEP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(z), b.column("toxic")], names=["lang", "z", "toxic"])

    found = rows.select("text", F.coalesce("lang", F.lit("")).alias("lang"), "toxic").mapInArrow(run, "lang string, z bigint, toxic bigint")
    found = found.groupBy("lang", "z").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("rows")).toArrow()
    sent.destroy()
    return found.sort_by([("z", "ascending"), ("lang", "ascending")])


def fit(
    docs: DataFrame, labels: DataFrame, words: int = 1 << 15, dims: int = 12, widths: tuple[int, ...] = (1, 2, 3), filters: int = 12, epochs: int = 5, block: int = 4096, least_texts: int = 4, seed: int = 5
) -> tuple[Net, dict[str, float]]:
    """A net and a threshold for each language, from every row whose id is labelled; a fifth of the ids calibrates only.

    With no labelled row at all, every score is the same. Rows without a language share one threshold. Labels that disagree count as toxic.
    Blocks have about `block` texts.
    """
    net = Net.first(words, dims, widths, filters, seed)
    known = written(labelled(docs, labels), "toxicity-labelled")
    all_n, apart_n = known.agg(F.count("*"), F.count(F.when(F.col("h") % 5 == 0, 1))).first()
    if not all_n:
        dropped(known)
        return net, {}
    if apart_n in (0, all_n):
        marked = numbered(known, [], ["h", "text"], "i").withColumn("apart", F.col("i") % 5 == 0)
    else:
        marked = known.withColumn("apart", F.col("h") % 5 == 0)
    rest = marked.where("not apart") if all_n > 1 else marked
    n, toxic, size = rest.agg(F.count("*"), F.sum("toxic"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // block), -(-size // BLOCK_BYTES))
    blocks = written(in_blocks(rest, parts, words, block), "toxicity-blocks")
    used_hash = hashes_seen(blocks, parts, words) >= least_texts
    net.embed[~used_hash] = 0
    net = started(net)
    rate_of = max(1.0, float(np.sqrt((n - toxic) / max(1, toxic))))
    for epoch in range(epochs):
        net = one_epoch(net, used_hash, rate_of, epoch, blocks, parts, seed)
    dropped(blocks)
    got = margins_seen(marked.where("apart"), net)
    dropped(known)
    net.moments, net.size = [], None
    z, y, rows, lang = got.column("z").to_numpy() / STEP, got.column("toxic").to_numpy(), got.column("rows").to_numpy(), got.column("lang").to_numpy()
    calibrated(net, z, y, rows)
    p, cuts = probability(net, z), {}
    for x in sorted(set(lang[y > 0])):
        here = lang == x
        cuts[x] = shrunk(best_cut(p[here], y[here], rows[here]), int(y[here].sum()))
    return net, cuts


def probability(net: Net, z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(net.scale * z + net.offset, -30, 30)))


def toxicity(docs: DataFrame, net: Net, cuts: dict[str, float]) -> DataFrame:
    """doc_id, score, predicted, lang_threshold and lang_toxic for every row of docs (doc_id, text, lang).

    The score depends on the text only; a null text is empty and has the empty text's score. Repeated rows and null ids stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast((net, cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, cuts = sent.value
        for b in (x for whole in batches for x in slices(whole)):
            pairs, ids, at = word_ids(b.column("text"), len(net.embed) // 2)
            p = probability(net, margins(net, tables_of(net, pairs), ids, at))
            cut = np.array([cuts.get(x or "", 0.5) for x in b.column("lang").to_pylist()])
            cols = [b.column("doc_id").cast(pa.int64()), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(cut, pa.float64()), pa.array((p >= cut).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted", "lang_threshold", "lang_toxic"])

    marked = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    return marked.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, lang_threshold double, lang_toxic int")


def held_out():
    return F.pmod(crc_of_id(), F.lit(5)) == 0
