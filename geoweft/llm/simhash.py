"""SimHash near-dedup: multi-index candidate blocks, compared over vertical bit planes with carry-save counters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .components import components

RADIUS, BLOCKS, TILE, CHUNK = 4, 6, 256, 1024
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
HOT_BROADCAST = 100_000  # rows of (key, parts); more are joined by shuffle


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Of a text with single spaces between its words: bit set if set in over half the shingles' XXH64; signed."""
    if not text:
        return 0
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    k = min(shingle, len(gaps) + 1)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(text)]))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(text[s:e], 42) for s, e in zip(starts[: len(starts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, gw_text (hash of the text) and gw_fp of every row; words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole)):
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(b.column("text"), "").cast(pa.large_string())))
            texts = (" ".join(w for w in x if w).encode() if "" in x else " ".join(x).encode() for x in (y.as_py() for y in lists))
            found = pa.array([fingerprint(t, shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("gw_text"), found], names=["doc_id", "gw_text", "gw_fp"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("gw_text")).mapInArrow(run, "doc_id bigint, gw_text bigint, gw_fp bigint")


def over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
    for bit in range(len(counters) - 1, -1, -1):
        if not radius >> bit & 1:
            above |= equal & counters[bit]
            equal &= ~counters[bit]
        else:
            equal &= counters[bit]
    return above


def count_in(x: np.ndarray, c: list[np.ndarray]) -> None:
    """Carry-save addition of one bit a lane; a counter that is full stays so."""
    carry = x
    for i, y in enumerate(c):
        c[i], carry = y ^ carry, y & carry
    if carry.any():
        for y in c:
            y |= carry


def close_pairs(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs i < j of uint64 fingerprints that differ in at most `radius` bits.

    Plane b holds bit b of 64 fingerprints a word. All fingerprints are queries at once: each plane xor the query's bit is
    added to bitwise counters, which hold one more than the radius at least. Words whose 64 lanes all exceed the radius are abandoned.
    """
    n, words = len(fps), -(-len(fps) // 64)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((words * 64, 64), np.uint8)
    padded[:n] = bits
    planes = np.packbits(padded.T.copy(), axis=1, bitorder="little").view(np.uint64)
    masks = np.where(bits.astype(bool), ALL, np.uint64(0))
    counters = [np.zeros((n, words), np.uint64) for _ in range((radius + 1).bit_length())]
    first = min(64, max(20, 2 * radius))
    for b in range(first):
        count_in(planes[b][None, :] ^ masks[:, b][:, None], counters)
    q, w = np.nonzero(over(counters, radius) != ALL)
    counters = [c[q, w] for c in counters]
    for b in range(first, 64):
        count_in(planes[b][w] ^ masks[q, b], counters)
        if b % 8 == 7:
            stay = np.flatnonzero(over(counters, radius) != ALL)
            q, w, counters = q[stay], w[stay], [c[stay] for c in counters]
    hit = np.unpackbits((~over(counters, radius)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, lane = np.nonzero(hit)
    i, j = q[k], w[k] * 64 + lane
    keep = (i < j) & (j < n)
    return i[keep], j[keep]


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index that each index reaches over the pairs."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gw_key, gw_tile, gw_fp) sorted by key and tile: links from each fingerprint to the least it reaches within its chunk of tiles."""
    rest = [np.zeros(0, np.int64)] * 3

    def links(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, tile, fp = cols
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(key)))
        fp, ends = fp[np.repeat(sizes > 1, sizes)], np.cumsum(sizes[sizes > 1])
        us, vs, at = [], [], 0
        while at < len(fp):
            k = int(np.searchsorted(ends, at + CHUNK, side="right")) - 1
            end = int(ends[k]) if k >= 0 and ends[k] > at else int(ends[np.searchsorted(ends, at, side="right")])
            part = np.unique(fp[at:end])
            label = least_labels(len(part), *close_pairs(part.view(np.uint64)))
            far = label != np.arange(len(part))
            us.append(part[far])
            vs.append(part[label[far]])
            at = end
        u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (us, vs))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for b in batches:
        cols = [np.concatenate((r, b.column(c).to_numpy())) for r, c in zip(rest, ("gw_key", "gw_tile", "gw_fp"), strict=True)]
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1])) if len(cols[0]) else np.zeros(0, int)
        cut = int(last[-1]) + 1 if len(last) else 0
        rest = [c[cut:] for c in cols]
        if cut:
            yield links([c[:cut] for c in cols])
    if len(rest[0]):
        yield links(rest)


def close_links(fps: DataFrame, blocks: int = BLOCKS, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (u, v) among distinct fingerprints (gw_fp) that connect all pairs within the radius, without listing all pairs.

    Two fingerprints within the radius agree in at least blocks - radius of the blocks, so they share the key of one choice of
    that many blocks. Keys with many fingerprints are split into parts of about `tile`; every pair of parts meets in a tile of
    its own. Only the number of parts is estimated, from a fixed sample of the fingerprints; links do not depend on it.
    """
    widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    lows = np.cumsum([0, *widths]).tolist()
    part = [F.shiftrightunsigned("gw_fp", lows[i]).bitwiseAND((1 << widths[i]) - 1) for i in range(blocks)]
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(t).cast("long")
        for i in chosen:
            key = F.shiftleft(key, widths[i]).bitwiseOR(part[i])
        keys.append(key)
    keyed = lambda rows: rows.select("gw_fp", F.explode(F.array(*keys)).alias("gw_key"))
    sampled = keyed(fps.where(F.pmod(F.xxhash64("gw_fp"), F.lit(16)) == 0)).groupBy("gw_key").count()
    hot = written(sampled.where(F.col("count") * 16 >= 2 * tile).select("gw_key", F.ceil(F.col("count") * 16 / tile).cast("int").alias("gw_parts")), "simhash-hot")
    rows, n_hot = keyed(fps), hot.count()
    if n_hot:
        rows = rows.join(F.broadcast(hot) if n_hot <= HOT_BROADCAST else hot, "gw_key", "left")
        mine = F.pmod(F.xxhash64(F.lit(7), "gw_fp"), F.col("gw_parts")).cast("int")
        tiles = F.transform(F.sequence(F.lit(0), F.col("gw_parts") - 1), lambda o: F.least(mine, o).cast("long") * 1_000_000 + F.greatest(mine, o))
        rows = rows.select("gw_key", "gw_fp", F.explode(F.when(F.col("gw_parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(tiles)).alias("gw_tile"))
    else:
        rows = rows.withColumn("gw_tile", F.lit(-1).cast("long"))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("gw_key", "gw_tile", "gw_fp").repartition(n, "gw_key", "gw_tile").sortWithinPartitions("gw_key", "gw_tile")
    return rows.mapInArrow(linked, "u bigint, v bigint")


def grouped(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """doc_id, gw_text (hash of the text), gw_fp, gw_root and component_id of every row."""
    marked = written(fingerprints(docs, shingle), "simhash-marked")
    fps = written(marked.groupBy("gw_fp").agg(F.min("doc_id").alias("gw_first")), "simhash-distinct")
    roots = components(close_links(fps, radius=radius))
    tied = fps.join(roots, F.col("gw_fp") == F.col("u"), "left").select("gw_fp", "gw_first", F.coalesce("v", "gw_fp").alias("gw_root"))
    tied = written(tied, "simhash-tied")
    names = written(tied.groupBy("gw_root").agg(F.min("gw_first").alias("component_id")), "simhash-names")
    named = written(tied.select("gw_fp", "gw_root").join(names, "gw_root"), "simhash-named")
    return marked.join(named, "gw_fp")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links) for every row of docs (doc_id, text).

    Equal fingerprints are one node. A null or empty text has fingerprint 0. Repeated rows stay; a row with a null id takes part
    like any other, but names no component (component_id is null where no id is left). An empty table gives no rows; other
    columns are not read, so their names cannot clash.
    """
    text = F.lower(F.lpad(F.hex("gw_fp"), 16, "0"))
    return grouped(docs, shingle, radius).select("doc_id", text.alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = 4, radius: int = RADIUS) -> DataFrame:
    """The documents, all columns, with one row of each component left: its smallest doc_id, then its least text hash.

    Null ids come after all others; rows equal in doc_id and text count as one. Columns of any name stay as they are.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("gw_late"), F.col("doc_id").alias("gw_id"), F.col("gw_text"))
    best = grouped(docs, shingle, radius).groupBy("gw_root").agg(F.min(rank).alias("gw_best")).select("gw_best.gw_id", F.col("gw_best.gw_text").alias("gw_hash"))
    same = docs["doc_id"].eqNullSafe(best["gw_id"]) & (F.xxhash64(docs["text"]) == best["gw_hash"])
    return docs.join(best, same, "left_semi").dropDuplicates(["doc_id", "text"])
