"""Hidden Markov language model over words, trained by Baum-Welch counts that are summed over partitions.

Emission: a state emits one of `classes` word classes (a fixed hash of the word; the end of a text has a class of its own), and
the class emits the word by the class's own word counts, smoothed so that each class keeps a share for unknown words:
(c + d) / (n + d (v + 1)). So the states' parameters have a fixed size while every distinct word of the corpus counts.
The likelihood of a whole text is exact: a scaled forward recursion over its classes plus the words' terms.

Training starts from a fixed random model. Every round sums counts over all training texts, each as one whole chain: long ones are
walked in segments that hand on the scaled forward and backward values, so memory is bounded and no transition is lost.

Words are told apart by their 64-bit XXH64. Counts of the words that are most frequent in all texts, held-out ones included (at most
`head`), are broadcast; texts' other words are joined with the rest of the counts by shuffle, which no single word can dominate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, dropped, hashed_words, slices, summed, written

#: The end of a text counts as the empty word.
END = int(np.uint64(xxhash.xxh64_intdigest(b"", 42)).view(np.int64))
TOKENS = 250_000  # of one group of sequences
SEGMENT = 2048  # steps of a sequence whose values are held at once
BYTES = 2_000_000  # of text held at once
LN10 = float(np.log(10))


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x (classes + 1)
    logs: list[float] = field(default_factory=list)

    @staticmethod
    def first(states: int, classes: int, seed: int = 17) -> Model:
        rng = np.random.default_rng(seed)
        move = np.full((states, states), 0.1 / max(states - 1, 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        emit = rng.gamma(1.0, 1.0, (states, classes + 1)) + 0.5
        return Model(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))


def packed(at: np.ndarray, tokens: int = TOKENS) -> Iterator[np.ndarray]:
    """Indices of sequences (first positions `at`), longest first, in groups of about so many tokens within one segment.

    So long sequences, of which only a segment is held at once, go side by side in greater number.
    """
    length = np.diff(at)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    group, have = 0, 0
    for i, n in enumerate(np.minimum(length[order], SEGMENT).tolist()):
        have += n
        if have >= tokens:
            yield order[group : i + 1]
            group, have = i + 1, 0
    if group < len(order):
        yield order[group:]


def walk(model: Model, seq: np.ndarray, starts: np.ndarray, length: np.ndarray, first: int, last: int, alpha: np.ndarray | None, logs: np.ndarray, steps: list | None = None, kind: type = np.float64) -> np.ndarray | None:
    """Scaled forward steps first..last-1 of sequences sorted by falling length, from `alpha` on; adds to their log-likelihoods."""
    emit, move, begin = np.ascontiguousarray(model.emit.T, kind), model.move.astype(kind), model.start.astype(kind)
    ones, at = np.ones(len(begin), kind), starts + first
    active = np.searchsorted(-length, -np.arange(first, last), side="left")  # sequences longer than t
    scale = np.ones(len(starts))  # product of a few steps' scales, as logarithms are dear
    for t, n in enumerate(active.tolist()):
        e = emit.take(seq.take(at[:n]), axis=0)
        at[:n] += 1
        alpha = e * begin if alpha is None else (alpha[:n] @ move) * e
        c = alpha @ ones
        r = (1 / c)[:, None]
        alpha *= r
        scale[:n] *= c
        if t % 8 == 7:
            logs += np.log(scale)
            scale.fill(1)
        if steps is not None:
            steps.append((alpha, e, r))
    logs += np.log(scale)
    return alpha


def forward(model: Model, seq: np.ndarray, starts: np.ndarray, length: np.ndarray, keep: bool = False):
    """Log-likelihoods of whole sequences sorted by falling length, and all steps' scaled values if kept."""
    logs, steps = np.zeros(len(starts)), [] if keep else None
    walk(model, seq, starts, length, 0, int(length[0]), None, logs, steps)
    return logs, steps or []


def expected(model: Model, seq: np.ndarray, at: np.ndarray, segment: int = SEGMENT, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of starts, moves and emissions over the sequences, and their log-likelihood; single steps are of this kind of float.

    The forward pass keeps its values only where a segment starts; the backward pass, from the last segment on, walks each one again.
    """
    (k, classes), back = model.emit.shape, np.ascontiguousarray(model.move.T, kind)
    starts_n, move_n, emit_n, total = np.zeros(k), np.zeros((k, k)), np.zeros((k, classes)), 0.0
    for group in packed(at):
        starts, length = at[:-1][group], np.diff(at)[group]
        firsts = list(range(0, int(length[0]), segment))
        logs, marks, alpha = np.zeros(len(starts)), [], None
        for s in firsts:
            marks.append(alpha)
            if s + segment < length[0]:
                alpha = walk(model, seq, starts, length, s, s + segment, alpha, logs, kind=kind)
        ahead = None  # backward value times emission over scale of the step after
        for s, mark in zip(reversed(firsts), reversed(marks), strict=True):
            last, steps, lost = min(s + segment, int(length[0])), [], np.zeros(len(starts))
            walk(model, seq, starts, length, s, last, mark, logs if s == firsts[-1] else lost, steps, kind)
            ids, weights = [], []
            for t in range(last - 1, s - 1, -1):
                alpha, e, r = steps[t - s]
                if ahead is None:
                    beta = np.ones(alpha.shape, kind)
                else:
                    m = len(ahead)
                    move_n += alpha[:m].T @ ahead
                    beta = ahead @ back
                    if m < len(alpha):
                        beta = np.concatenate([beta, np.ones((len(alpha) - m, k), kind)])
                ids.append(seq.take(starts[: len(alpha)] + t))
                weights.append(alpha * beta)
                beta *= e
                beta *= r
                ahead = beta
            if s == 0:
                starts_n += weights[-1].sum(0)
            flat, w = np.concatenate(ids), np.concatenate(weights)
            order = np.argsort(flat.astype(np.uint16) if classes <= 1 << 16 else flat, kind="stable")
            flat = flat[order]
            new = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
            emit_n[:, flat[new]] += np.add.reduceat(w[order], new, axis=0, dtype=np.float64).T
        total += float(logs.sum())
    return starts_n, move_n * model.move, emit_n, total


def updated(model: Model, starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, prior: float = 20.0) -> Model:
    """Counts to probabilities; emissions lean on the classes' overall shares by `prior` counts, so none is 0."""
    share = (emits.sum(0) + 1e-3) / (emits.sum() + 1e-3 * emits.shape[1])
    emit = emits + prior * share
    move, start = moves + 0.1, starts + 0.1
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True), model.logs)


def class_sequences(texts: pa.Array, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens, ends included, and the texts' first positions."""
    uniq, idx, at = hashed_words(texts)
    return class_sequences_of((uniq % classes).astype(np.int32), idx, at, classes)


@dataclass
class Language:
    """A trained model; vocab holds h (hash of the word), c (its count in training texts) and n (in all) for every word but the end."""

    model: Model
    vocab: DataFrame
    head_from: int
    head: tuple[np.ndarray, np.ndarray]
    class_n: np.ndarray
    class_v: np.ndarray
    ends: int
    train_tokens: int
    distinct: int
    delta: float


def word_counts(docs: DataFrame) -> DataFrame:
    """h, c (in rows that aren't held out) and n (in all) of each distinct token of docs (text, held_out), ends included as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> pa.RecordBatch:
            h, c, n = (np.concatenate([x[i] for x in held]) for i in range(3))
            u, back = np.unique(h, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(u), *[pa.array(np.bincount(back, x).astype(np.int64)) for x in (c, n)]], names=["h", "c", "n"])

        for b in (x for whole in batches for x in slices(whole, most=BYTES)):
            uniq, idx, at = hashed_words(b.column("text"))
            learnt = ~b.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            c = np.bincount(idx, np.repeat(learnt, np.diff(at)), len(uniq)) if len(idx) else np.zeros(len(uniq))
            held.append((np.append(uniq, END), np.append(c, learnt.sum()), np.append(np.bincount(idx, minlength=len(uniq)), b.num_rows)))
            size += len(uniq) + 1
            if size > 500_000:
                yield merged()
                held, size = [], 0
        if held:
            yield merged()

    return docs.select("text", "held_out").mapInArrow(run, "h bigint, c bigint, n bigint").groupBy("h").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def class_table(docs: DataFrame, classes: int) -> DataFrame:
    """seq: the classes of each text's tokens, its end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, most=BYTES)):
            seq, at = class_sequences(b.column("text"), classes)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(seq.astype(np.int32)))], names=["seq"])

    return docs.select("text").mapInArrow(run, "seq array<int>")


def one_round(model: Model, table: DataFrame) -> Model:
    """The model after one Baum-Welch step on every sequence of the table; tasks send sums as large as the model."""
    k, width = model.emit.shape

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + k + k * k + k * width)
        for b in batches:
            at = b.column("seq").offsets.to_numpy().astype(np.int64)
            s, m, e, log = expected(model, b.column("seq").flatten().to_numpy(), at - at[0], kind=np.float32)
            total += np.concatenate([[log], s, m.ravel(), e.ravel()])
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], names=["idx", "val"])

    got = summed(table.mapInArrow(counts, "idx int, val double"))
    flat = np.zeros(1 + k + k * k + k * width)
    flat[list(got)] = list(got.values())
    after = updated(model, flat[1 : 1 + k], flat[1 + k : 1 + k + k * k].reshape(k, k), flat[1 + k + k * k :].reshape(k, width))
    after.logs.append(float(flat[0]))
    return after


def train(docs: DataFrame, states: int = 8, classes: int = 4096, rounds: int = 5, head: int = 1 << 18, delta: float = 0.5) -> Language:
    """Fit on every row of docs (text, held_out) that isn't held out: all words are counted, and each of the `rounds` sums counts over all texts.

    Held-out rows only tell which words are frequent enough to be broadcast; no count of theirs reaches the model.
    """
    vocab = written(word_counts(docs), "hmm-words")
    words = vocab.where(F.col("h") != END)
    klass = F.pmod(F.col("h"), F.lit(classes))
    by_class = words.where("c > 0").groupBy(klass.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    class_n, class_v = np.zeros(classes), np.zeros(classes)
    for r in by_class:
        class_n[r["k"]], class_v[r["k"]] = r["n"], r["v"]
    tokens, distinct = vocab.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    steps = words.groupBy(F.floor(F.log("n") * 64).alias("step")).agg(F.min("n").alias("least"), F.count("*").alias("many")).orderBy(F.desc("step")).collect()
    head_from, have = 1 << 62, 0
    for _, least, many in steps:
        if have + many > head:
            break
        head_from, have = least, have + many
    top = words.where(F.col("n") >= head_from).select("h", "c").toArrow().sort_by("h")
    known = (top.column("h").to_numpy(), top.column("c").to_numpy())
    ends = vocab.where(F.col("h") == END).first()
    n_docs, model = int(ends["c"]) if ends else 0, Model.first(states, classes)
    if n_docs:
        table = written(class_table(docs.where(~F.col("held_out")), classes), "hmm-classes")
        for _ in range(rounds):
            model = one_round(model, table)
        dropped(table)
    return Language(model, words, head_from, known, class_n, class_v, n_docs, int(tokens), int(distinct), delta)


SCORED = "uid bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, rare_h array<bigint>, rare_n array<bigint>"


def scored(docs: DataFrame, lang: Language) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text, held_out); logs to base 10.

    A null text is empty: one token, the end. With nothing to train on, every token has probability 1 in the base. Repeated ids and
    null ids keep their rows; other columns are not read.
    """
    spark = docs.sparkSession
    classes, delta = lang.model.emit.shape[1] - 1, lang.delta
    sent = spark.sparkContext.broadcast((lang.model, lang.head, lang.class_n, lang.class_v))
    norm = float(np.log10(lang.train_tokens + lang.distinct + 1))
    ends = lang.ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, (head_h, head_c), class_n, class_v = sent.value
        uid = TaskContext.get().partitionId() << 40
        for whole in batches:
            parts, chains = [], []
            for b in slices(whole, most=BYTES):
                uniq, idx, at = hashed_words(b.column("text"))
                n = np.diff(at)
                rows = len(n)
                pos = np.minimum(np.searchsorted(head_h, uniq), max(len(head_h) - 1, 0))
                inside = head_h[pos] == uniq if len(head_h) else np.zeros(len(uniq), bool)
                c = np.where(inside, head_c[pos], 0) if len(head_h) else np.zeros(len(uniq), np.int64)
                klass, known = (uniq % classes).astype(np.int32), c > 0
                base = np.where(inside, np.log10(c + 1.0) - norm, 0.0)
                word = np.where(inside, np.log10((c + delta) / (class_n[klass] + delta * (class_v[klass] + 1))), 0.0)
                rows_of = np.repeat(np.arange(rows), n)
                per_row = lambda x, idx=idx, rows=rows, rows_of=rows_of: np.bincount(rows_of, x[idx], rows) if len(idx) else np.zeros(rows)
                rare = np.flatnonzero(~inside[idx]) if len(idx) else np.zeros(0, int)
                pair, times = np.unique(rows_of[rare] * np.int64(len(uniq) + 1) + idx[rare], return_counts=True)
                row, word_i = pair // (len(uniq) + 1), pair % (len(uniq) + 1)
                offsets = pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32))
                chains.append(class_sequences_of(klass, idx, at, classes))
                parts.append(
                    [
                        pa.array(np.arange(uid, uid + rows)), b.column("doc_id").cast(pa.int64()), b.column("held_out"), pa.array(n.astype(np.int64) + 1),
                        pa.array((per_row(known.astype(float)) + (ends > 0)).astype(np.int64)), pa.array(per_row(base) + np.log10(ends + 1.0) - norm),
                        per_row(word), pa.ListArray.from_arrays(offsets, pa.array(uniq[word_i])), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))),
                    ]
                )
                uid += rows
            if not parts:
                continue
            seq, length = np.concatenate([s for s, _ in chains]), np.concatenate([np.diff(at) for _, at in chains])
            at, logs, low = np.concatenate(([0], np.cumsum(length))), np.zeros(len(length)), 0
            for group in packed(at):
                logs[group] = forward(model, seq, at[:-1][group], length[group])[0]
            for cols in parts:
                high = low + len(cols[0])
                cols[6] = pa.array(logs[low:high] / LN10 + cols[6])
                low = high
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCORED.split(", ")])

    first = written(docs.select("doc_id", "text", "held_out").mapInArrow(run, SCORED), "hmm-scored")
    rare = first.select("uid", F.explode(F.arrays_zip("rare_h", "rare_n")).alias("r")).select("uid", F.col("r.rare_h").alias("h"), F.col("r.rare_n").alias("times"))
    sizes = spark.createDataFrame([(k, float(lang.class_n[k]), float(lang.class_v[k])) for k in range(classes)], "k int, cn double, cv double")
    c = F.coalesce("c", F.lit(0))
    rare = rare.join(lang.vocab.where((F.col("n") < lang.head_from) & (F.col("c") > 0)).select("h", "c"), "h", "left").withColumn("k", F.pmod("h", F.lit(classes)).cast("int")).join(F.broadcast(sizes), "k")
    rest = rare.groupBy("uid").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * (F.log10(c + 1) - F.lit(norm))).alias("more_base"),
        F.sum(F.col("times") * F.log10((c + F.lit(delta)) / (F.col("cn") + F.lit(delta) * (F.col("cv") + 1)))).alias("more_word"),
    )
    more = lambda x: F.coalesce(x, F.lit(0))
    return first.join(rest, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more("more_known")).cast("long").alias("n_known"), F.lit(lang.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + more("more_base")).alias("base_score"), (F.col("score") + more("more_word")).alias("score"),
    )


def class_sequences_of(klass: np.ndarray, idx: np.ndarray, at: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """As class_sequences, from words already hashed."""
    return np.insert(klass[idx] if len(idx) else np.zeros(0, np.int32), at[1:], classes), at + np.arange(len(at))


def held_out(modulus: int = 7, remainder: int = 2):
    return F.pmod(crc_of_id(), F.lit(modulus)) == remainder


def language_scores(docs: DataFrame, **options) -> DataFrame:
    """Train on the rows that aren't held out and score all rows."""
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return scored(rows, train(rows, **options))
