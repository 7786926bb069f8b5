"""Near copies by the similarity of their shingle sets, found over SimHash fingerprints in bit planes and verified exactly.

Two texts are linked if their sets of word shingles have a Jaccard similarity of `least` or more. At 0.8, fingerprints of 64 bits differ
in about 10 bits, so blocks of bits are no selective keys. Keys are a text's least shingle hashes instead: of two texts at 0.8, the
least `KEYS` miss each other with a chance below 0.0001. Texts that share a key are compared over bit planes within `radius` bits
(beyond it by chance: 0.0002 at 0.8), then by their whole shingle sets.

A key that many texts share (a common passage) is left to texts that have too few other keys. What stays is split into parts: first
each part links its own texts; then the texts with most links of every part's groups are compared, which joins what
belongs to one original; last, texts of groups that are still apart meet part by part. No link is lost, and no pair is listed: a text
stands at most once in each tile, and tiles are verified whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, flat_words, slices, written
from .components import components
from .simhash import close_pairs, least_labels

KEYS, SPARE, RADIUS, TILE, CHUNK = 6, 12, 20, 512, 1024
HOT = 2 * TILE  # texts of a key that is split
HOT_BROADCAST = 100_000
BYTES = 2_000_000  # of text held at once
COLUMNS = 4096  # shingles of one step of the exact comparison
KEYED = "gw_key bigint, gw_tile bigint, gw_part int, gw_text bigint, gw_fp bigint, gw_n int, gw_keys array<bigint>, gw_class bigint"


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, rising, and first positions. A text of fewer words has its whole sequence as one; one without words has 0."""
    flat, at = flat_words(texts)
    coded = flat.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    words = np.fromiter((digest(w, 42) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h, n = words[coded.indices.to_numpy()] if len(flat) else words, np.diff(at)
    rolled = np.zeros(max(len(h) - shingle + 1, 0), np.uint64)
    for j in range(shingle):
        rolled = (rolled ^ h[j : j + len(rolled)]) * np.uint64(0x9E3779B97F4A7C15)
        rolled ^= rolled >> np.uint64(29)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    rolled ^= rolled >> np.uint64(32)
    count = np.maximum(n - shingle + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    full = rolled[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[:-1], count)]
    short = np.flatnonzero(n < shingle)
    whole = np.array([digest(" ".join(flat[at[i] : at[i + 1]].to_pylist()), int(n[i]) + 1) if n[i] else 0 for i in short.tolist()], np.uint64)
    row, full = np.concatenate([row, short]), np.concatenate([full, whole])
    order = np.lexsort((full, row))
    row, full = row[order], full[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (full[1:] != full[:-1])
    return full[fresh], np.searchsorted(row[fresh], np.arange(len(n) + 1))


def marked(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, gw_text (hash of the text), gw_fp, gw_n (distinct shingles) and gw_keys (the least hashes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, most=BYTES)):
            h, at = shingle_sets(b.column("text"), shingle)
            n = np.diff(at)
            ones = np.add.reduceat(np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), at[:-1], axis=0, dtype=np.int32)
            fp = np.packbits(ones * 2 > n[:, None], axis=1, bitorder="little").view("<i8")[:, 0]
            some = np.minimum(n, SPARE)
            pick = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + np.repeat(at[:-1], some)
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some))).astype(np.int32)), pa.array(h[pick].view(np.int64)))
            cols = [b.column("doc_id").cast(pa.int64()), b.column("gw_text"), pa.array(fp), pa.array(n.astype(np.int32)), keys]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "gw_text", "gw_fp", "gw_n", "gw_keys"])

    kind = "doc_id bigint, gw_text bigint, gw_fp bigint, gw_n int, gw_keys array<bigint>"
    return docs.select("doc_id", F.xxhash64("text").alias("gw_text"), "text").mapInArrow(run, kind)


def tile_by_tile(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gw_key and gw_tile, regrouped so that no tile is cut: tiles of two rows or more, about `chunk` rows together."""
    rest: list[pa.RecordBatch] = []
    for b in chained(batches):
        if b is not None and b.num_rows:
            rest.append(b)
            if sum(x.num_rows for x in rest) < chunk:
                continue
        if not rest:
            continue
        held = pa.Table.from_batches(rest).combine_chunks()
        key, tile = held.column("gw_key").to_numpy(), held.column("gw_tile").to_numpy()
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]))))
        end = len(key) if b is None else int(new[-1])
        rest = held.slice(end).to_batches() if end < len(key) else []
        sizes = np.diff(np.append(new[new < end], end))
        keep = np.flatnonzero(np.repeat(sizes > 1, sizes))
        ends, low = np.cumsum(sizes[sizes > 1]), 0
        while low < len(keep):
            k = int(np.searchsorted(ends, low + chunk, side="right")) - 1
            high = int(ends[k]) if k >= 0 and ends[k] > low else int(ends[np.searchsorted(ends, low, side="right")])
            yield held.take(pa.array(keep[low:high])).combine_chunks().to_batches()[0]
            low = high


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_in(b: pa.RecordBatch, least: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one tile within the radius whose sizes allow the similarity, of different classes, and for which the tile is the one to look in.

    That is the tile of the least key that both have. Parts of a split key meet in a tile of their own, where only pairs across count.
    """
    col = lambda c: b.column(c).to_numpy()
    i, j = close_pairs(col("gw_fp").view(np.uint64), radius)
    key, tile, part, n, kind = (col(c) for c in ("gw_key", "gw_tile", "gw_part", "gw_n", "gw_class"))
    low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    ok = (key[i] == key[j]) & (tile[i] == tile[j]) & (kind[i] != kind[j]) & (low >= least * high - 1e-9) & ((part[i] != part[j]) | (tile[i] < 0) | (tile[i] % 1_000_001 == 0))
    i, j = i[ok], j[ok]
    keys = b.column("gw_keys")
    many = np.diff(keys.offsets.to_numpy())
    table = np.zeros((b.num_rows, SPARE), np.uint64)
    held = np.arange(SPARE)[None, :] < many[:, None]
    table[held] = keys.flatten().to_numpy().view(np.uint64)
    first = np.full(len(i), np.iinfo(np.uint64).max)
    for x in range(SPARE):
        for y in range(SPARE):
            same = (table[i, x] == table[j, y]) & held[i, x] & held[j, y]
            first[same] = np.minimum(first[same], table[i, x][same])
    mine = first == key[i].view(np.uint64)
    return i[mine], j[mine]


def involved(keyed: DataFrame, least: float, radius: int) -> DataFrame:
    """gw_key, gw_tile, gw_text of the texts with a near one of another class in their tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tile_by_tile(batches):
            who = np.unique(np.concatenate(near_in(b, least, radius)))
            yield b.select(["gw_key", "gw_tile", "gw_text"]).take(pa.array(who))

    return by_tile(keyed, KEYED).mapInArrow(run, "gw_key bigint, gw_tile bigint, gw_text bigint")


def by_tile(rows: DataFrame, kind: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [x.split()[0] for x in kind.split(", ")]
    return rows.select(*names).repartition(n, "gw_key", "gw_tile").sortWithinPartitions("gw_key", "gw_tile")


def alike(h: np.ndarray, at: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs i < j of shingle sets whose Jaccard similarity is `least` or more, by counting common shingles, some columns at a time."""
    n, size = len(at) - 1, np.diff(at)
    uniq, col, times = np.unique(h, return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(n), size), times[col] > 1
    row, col = row[shared], np.cumsum(times > 1)[col[shared]] - 1
    order, both = np.argsort(col, kind="stable"), np.zeros((n, n), np.float32)
    row, col = row[order], col[order]
    for low in range(0, int((times > 1).sum()), COLUMNS):
        a, z = np.searchsorted(col, (low, low + COLUMNS))
        block = np.zeros((n, COLUMNS), np.float32)
        block[row[a:z], col[a:z] - low] = 1
        both += block @ block.T
    i, j = np.nonzero(np.triu(both.astype(np.float64) * (1 + least) >= least * (size[:, None] + size[None, :]) - 1e-6, 1))
    return i, j


def verified(members: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links (u, v) within each tile of members (gw_key, gw_tile, gw_text) that join all its texts whose sets are alike; v is the text with most links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tile_by_tile(batches, CHUNK // 8):
            key, tile, text = (b.column(c).to_numpy() for c in ("gw_key", "gw_tile", "gw_text"))
            _, one, of = np.unique(text, return_index=True, return_inverse=True)
            h, at = shingle_sets(b.column("text").take(pa.array(one)), shingle)
            new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]))))
            us, vs = [], []
            for s, e in zip(new, np.append(new[1:], len(key)), strict=True):
                own = np.unique(of[s:e])
                part = [h[at[k] : at[k + 1]] for k in own]
                i, j = alike(np.concatenate(part), np.concatenate(([0], np.cumsum([len(x) for x in part]))), least)
                label, ids = least_labels(len(own), i, j), text[one[own]]
                degree = np.bincount(np.concatenate([i, j]), minlength=len(own))
                order = np.lexsort((ids, -degree, label))
                hub = order[np.searchsorted(label[order], label)]
                far = np.flatnonzero(hub != np.arange(len(own)))
                us.append(ids[far])
                vs.append(ids[hub[far]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs)], names=["u", "v"])

    rows = by_tile(members.join(texts, "gw_text"), "gw_key bigint, gw_tile bigint, gw_text bigint, text string")
    return rows.mapInArrow(run, "u bigint, v bigint")


def parted(keyed: DataFrame, across: bool) -> DataFrame:
    """Rows of split keys (gw_parts) in the tiles of their own part, or in those of every two parts."""
    tile = lambda a, z: a.cast("long") * 1_000_000 + z.cast("long")
    mine = F.pmod(F.xxhash64(F.lit(7), "gw_text"), F.col("gw_parts")).cast("int")
    rows = keyed.withColumn("gw_part", mine)
    part = F.col("gw_part")
    if not across:
        return rows.withColumn("gw_tile", F.when(F.col("gw_parts") > 1, tile(part, part)).otherwise(F.lit(-1).cast("long")))
    others = F.filter(F.sequence(F.lit(0), F.col("gw_parts") - 1), lambda o: o != part)
    return rows.where("gw_parts > 1").select("*", F.explode(F.transform(others, lambda o: tile(F.least(part, o), F.greatest(part, o)))).alias("gw_tile"))


def links(marks: DataFrame, docs: DataFrame, shingle: int, least: float, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Written links (u, v) of gw_text values that join all distinct texts of marks that are alike."""
    slim = written(marks.groupBy("gw_text").agg(F.first("gw_fp").alias("gw_fp"), F.first("gw_n").alias("gw_n"), F.first("gw_keys").alias("gw_keys"), F.min("doc_id").alias("gw_first")), "similar-slim")
    each = slim.select("gw_text", F.explode("gw_keys").alias("gw_key"))
    hot = written(each.groupBy("gw_key").count().where(F.col("count") >= 2 * tile).select("gw_key"), "similar-hot")
    n_hot = hot.count()
    small = lambda t, n: F.broadcast(t) if n <= HOT_BROADCAST else t
    if n_hot:
        warm = each.join(small(hot, n_hot), "gw_key").groupBy("gw_text").agg(F.collect_list("gw_key").alias("gw_warm"))
        cold = F.array_except("gw_keys", F.coalesce("gw_warm", F.array().cast("array<bigint>")))
        use = F.when(F.size(cold) >= KEYS, F.slice(cold, 1, KEYS)).when(F.col("gw_warm").isNull(), F.slice("gw_keys", 1, KEYS)).otherwise(F.col("gw_keys"))
        used = slim.join(warm, "gw_text", "left").withColumn("gw_keys", use).drop("gw_warm")
    else:
        used = slim.withColumn("gw_keys", F.slice("gw_keys", 1, KEYS))
    keyed = used.select("gw_text", "gw_fp", "gw_n", "gw_keys", F.explode("gw_keys").alias("gw_key"), F.col("gw_text").alias("gw_class"))
    if n_hot:
        parts = keyed.join(small(hot, n_hot), "gw_key", "left_semi").groupBy("gw_key").agg(F.ceil(F.count("*") / tile).cast("int").alias("gw_parts"))
        parts = written(parts, "similar-parts")
        keyed = keyed.join(small(parts, n_hot), "gw_key", "left").withColumn("gw_parts", F.coalesce("gw_parts", F.lit(1)))
    else:
        keyed = keyed.withColumn("gw_parts", F.lit(1))
    texts = docs.select("doc_id", F.xxhash64("text").alias("gw_text"), "text")

    def checked(members: DataFrame, name: str) -> DataFrame:
        who = written(members, "similar-members")
        first = who.select("gw_text").distinct().join(slim.select("gw_text", "gw_first"), "gw_text")
        found = texts.alias("t").join(first.alias("f"), (F.col("t.gw_text") == F.col("f.gw_text")) & F.col("t.doc_id").eqNullSafe(F.col("f.gw_first"))).select("t.gw_text", "t.text")
        out = written(verified(who, found, shingle, least), name)
        dropped(who)
        return out

    edges = checked(involved(parted(keyed, False), least, radius), "similar-links")
    if not n_hot or parts.where("gw_parts > 1").isEmpty():
        return edges

    def classed() -> DataFrame:
        roots = components(edges).select(F.col("u").alias("gw_text"), F.col("v").alias("gw_root"))
        return keyed.where("gw_parts > 1").join(roots, "gw_text", "left").withColumn("gw_class", F.coalesce("gw_root", "gw_text"))

    hubs = classed().join(edges.select(F.col("v").alias("gw_text")).distinct(), "gw_text", "left_semi").drop("gw_parts")
    fewer = hubs.groupBy("gw_key").agg(F.ceil(F.count("*") / tile).cast("int").alias("gw_parts"))
    for rows, across in ((hubs.join(fewer, "gw_key"), False), (None, True)):
        found = checked(involved(parted(classed() if across else rows, across), least, radius), "similar-more")
        edges = written(edges.union(found), "similar-links")
    return edges


def grouped(docs: DataFrame, shingle: int = 5, least: float = 0.8, **options) -> DataFrame:
    """doc_id, gw_text (hash of the text) and gw_root (that of a text of its group) of every row of docs (doc_id, text).

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. Texts with fewer words than a shingle are alike only if their words are equal; texts
    without words, nulls included, are alike. Groups are those that chains of links reach. Repeated rows and null ids stay; an empty
    table gives no rows; other columns are not read.
    """
    marks = written(marked(docs, shingle), "similar-marks")
    roots = components(links(marks, docs, shingle, least, **options))
    return marks.join(roots, F.col("gw_text") == F.col("u"), "left").select("doc_id", "gw_text", F.coalesce("v", "gw_text").alias("gw_root"))


def first_of_each(docs: DataFrame, shingle: int = 5, least: float = 0.8, **options) -> DataFrame:
    """The documents, all columns, with one row of each group left: its smallest doc_id, then its least text hash.

    Null ids come after all others; rows equal in doc_id and text count as one. Columns of any name stay as they are.
    """
    rows = written(grouped(docs, shingle, least, **options), "similar-grouped")
    rank = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), F.col("gw_text").alias("hash"))
    best = rows.groupBy("gw_root").agg(F.min(rank).alias("best")).select(F.col("best.id").alias("gw_best_id"), F.col("best.hash").alias("gw_best_hash"))
    same: Column = docs["doc_id"].eqNullSafe(best["gw_best_id"]) & (F.xxhash64(docs["text"]) == best["gw_best_hash"])
    kept = docs.join(best, same, "left_semi")
    if rows.groupBy("doc_id", "gw_text").count().where("count > 1").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])
