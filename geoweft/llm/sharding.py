"""Sharding: minimax contiguous partition of atomic groups (equal texts), native DataFrame operations only.

Groups stand in the order of a 63-bit hash of their text. The smallest feasible shard capacity is found by binary search
with a greedy check. The check does not need every group: it runs over a histogram of key ranges whose size is bounded
(`max_bins`). A range that is still coarse counts once as divisible at will (a lower bound of the capacity) and once as one
atom (an upper bound); only ranges that hold a possible cut are split further, until both bounds meet. Ranges that hold much of a
fair share are split first, so one large group is soon an atom of its own and cannot drive the bounds apart. So the result is
that of the search over all groups, while the driver holds at most a few times `max_bins` sums. The ranges to split are looked up
by their key prefix in a table of at most `max_bins` rows, whatever their number.

Greedy filling would leave the last shards empty beside one very large group; so, within the optimal capacity, each cut is put
where the remaining bytes divide evenly over the remaining shards.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PLACE, numbered, with_place, written

KEY_BITS = 63


FILE_CELL = 16  # bits of the row number within a file that share a cell


def slim(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, size, text_crc32, group key and what else is asked for. A null text has size 8, checksum 0, and is a group of its own."""
    return docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64("text"), 1).alias("gw_key"),
        *more,
    )


class Bins:
    """Key ranges in order: [start, end], bytes, and whether the range is a single group."""

    def __init__(self, rows: list[tuple[int, int, int, bool]]):
        self.rows = sorted(rows)
        self.sums = [0]
        for r in self.rows:
            self.sums.append(self.sums[-1] + r[2])

    def greedy(self, capacity: int, divisible: bool, shards: int) -> list[float] | None:
        """Cuts in bytes, or None if more than `shards` are needed; divisible: a range that isn't a single group can be cut anywhere."""
        at, cuts, total = 0, [], self.sums[-1]
        for _ in range(shards):
            if at + capacity >= total:
                return cuts
            i = bisect_right(self.sums, at + capacity) - 1
            nxt = at + capacity if divisible and i < len(self.rows) and not self.rows[i][3] else self.sums[i]
            if nxt <= at:
                return None
            cuts.append(nxt)
            at = nxt
        return cuts if at >= total else None

    def least(self, shards: int, divisible: bool) -> int:
        low, high = -(-self.sums[-1] // shards), max(self.sums[-1], 1)
        while low < high:
            mid = (low + high) // 2
            if self.greedy(mid, divisible, shards) is None:
                low = mid + 1
            else:
                high = mid
        return low

    def cuts(self, shards: int, capacity: int) -> list[int]:
        """Even cuts within the capacity, as indices of ranges: each between what the rest needs and what the shard may hold.

        Groups above a fair share of what is left without them stand alone where the capacity allows, and no shard is empty while
        there is a range to put into it.
        """
        sums, n = self.sums, len(self.rows)
        latest = [n] * (shards + 1)  # from latest[j] on, shards - j shards are enough
        for j in range(shards - 1, 0, -1):
            latest[j] = bisect_left(sums, sums[latest[j + 1]] - capacity)
        light, slots, large = sums[-1], shards, []
        for i in sorted((i for i in range(n) if self.rows[i][3]), key=lambda i: -self.rows[i][2])[: shards - 1]:
            if self.rows[i][2] * slots <= light:
                break
            light, slots = light - self.rows[i][2], slots - 1
            large.append(i)
        large.sort()
        out, at = [], 0
        for j in range(1, shards):
            ahead = large[bisect_left(large, at) :]
            low, high = max(min(at + 1, n), latest[j]), bisect_right(sums, sums[at] + capacity) - 1
            if ahead and ahead[0] == at:
                i = at + 1
            else:
                left = max(shards - j + 1 - len(ahead), 1)
                want = sums[at] + (sums[-1] - sums[at] - sum(self.rows[k][2] for k in ahead)) / left
                i = bisect_left(sums, want)
                if i > 0 and (i > n or want - sums[i - 1] < sums[i] - want):
                    i -= 1
                i = min(i, ahead[0]) if ahead else i
            at = min(max(i, low), max(high, low))
            out.append(at)
        return out


def held_by(rows: DataFrame, prefixes: list[int], shift: int) -> DataFrame:
    """The rows whose key, without its last `shift` bits, is one of the prefixes; their number is bounded by the histogram's."""
    listed = rows.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(prefixes)), "array<bigint>")).alias("gw_prefix"))
    return rows.join(F.broadcast(listed), F.shiftright("gw_key", shift) == F.col("gw_prefix"), "left_semi")


def plan(rows: DataFrame, shards: int, max_bins: int = 1 << 16, first_bits: int = 12) -> tuple[list[int], int]:
    """The last key of every shard but the last (-1: nothing yet), and the optimal capacity."""

    def histogram(some: DataFrame, shift: int) -> list[tuple[int, int, int, bool]]:
        got = some.groupBy(F.shiftright("gw_key", shift).alias("bin")).agg(F.sum("size").alias("s"), F.min("gw_key").alias("a"), F.max("gw_key").alias("b")).collect()
        return [(r["bin"] << shift, ((r["bin"] + 1) << shift) - 1, r["s"], r["a"] == r["b"]) for r in got]

    bins = Bins(histogram(rows, KEY_BITS - first_bits))
    while True:
        total = bins.sums[-1]
        coarse = {i for i, r in enumerate(bins.rows) if not r[3] and r[2] * 8 * shards > total}
        if not coarse:
            low, high = bins.least(shards, True), bins.least(shards, False)
            ends = bins.cuts(shards, high)
            coarse = open_bins(bins, shards, low, high, ends)
        if not coarse:
            break
        width = max(bins.rows[i][1] - bins.rows[i][0] + 1 for i in coarse).bit_length() - 1
        gain = min(width, max(1, (max_bins // len(coarse)).bit_length() - 1))
        fresh: list[tuple[int, int, int, bool]] = []
        for w in sorted({bins.rows[i][1] - bins.rows[i][0] + 1 for i in coarse}):
            shift = w.bit_length() - 1
            prefixes = [bins.rows[i][0] >> shift for i in sorted(coarse) if bins.rows[i][1] - bins.rows[i][0] + 1 == w]
            fresh += histogram(held_by(rows, prefixes, shift), max(0, shift - gain))
        bins = Bins([r for i, r in enumerate(bins.rows) if i not in coarse] + fresh)
    return [bins.rows[i - 1][1] if i else -1 for i in ends], high


def open_bins(bins: Bins, shards: int, low: int, high: int, ends: list[int]) -> set[int]:
    """Ranges that can still hold a cut: between the bounds' cuts while these differ, then those around the cuts, if not yet fine."""
    spans = [(bins.sums[i], bins.sums[i]) for i in ends]
    if low < high:
        a, b = bins.greedy(low, True, shards) or [], bins.greedy(high, False, shards) or []
        spans += [(min(x, y), max(x, y)) for x, y in zip(a, b, strict=False)] + [(x, x) for x in [*a, *b]]
    coarse: set[int] = set()
    for x, y in spans:
        for i in range(max(0, bisect_left(bins.sums, x) - 1), min(len(bins.rows), bisect_right(bins.sums, y))):
            if not bins.rows[i][3] and (low < high or bins.rows[i][2] * 10_000 * shards > bins.sums[-1]):
                coarse.add(i)
    return coarse


def above(key: Column, ends: list[int], first: int = 0) -> Column:
    """How many of the rising ends are less than the key, by halving: the expression is as deep as the logarithm of their number."""
    if not ends:
        return F.lit(first)
    mid = len(ends) // 2
    return F.when(key > F.lit(ends[mid]), above(key, ends[mid + 1 :], first + mid + 1)).otherwise(above(key, ends[:mid], first))


COLUMNS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def numbered_shards(rows: DataFrame, shards: int, max_bins: int) -> DataFrame:
    ends, _ = plan(rows, shards, max_bins)
    return rows.withColumn("law", F.lit("bytes")).withColumn("shard", above(F.col("gw_key"), ends).cast("int")).withColumn("grown_shard", F.lit(None).cast("int"))


def shard(docs: DataFrame, shards: int = 24, max_bins: int = 1 << 16) -> DataFrame:
    """Put every row of `docs` (doc_id, text) into shards 0..shards-1 of nearly equal bytes.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 within the shard, by a hash), grown_shard (null).
    Equal texts share a shard. Null ids and repeated rows keep a row and a slot each; an empty table gives no rows; other columns
    are not read, so their names cannot clash.
    """
    rows = numbered_shards(written(slim(docs), "shard-sizes"), shards, max_bins)
    rows = numbered(rows, ["shard"], ["doc_id", "gw_key", "size"], "slot")
    return rows.select("doc_id", *[F.col(c).cast("long") if c == "slot" else F.col(c) for c in COLUMNS])


def sharded_documents(docs: DataFrame, shards: int = 24, max_bins: int = 1 << 16) -> DataFrame:
    """All rows and columns of `docs`, with what shard() adds in place of columns of the same names; slots follow the rows' order in the files.

    Only keys and sizes are numbered; the rows themselves move once, to meet their numbers.
    """
    rows = with_place(docs)
    keys = numbered_shards(written(slim(rows, *[F.col(c) for c in PLACE]), "shard-sizes"), shards, max_bins)
    cell = F.struct(PLACE[0], PLACE[1], F.shiftright(PLACE[2], FILE_CELL).alias("run"))
    keys = numbered(keys, ["shard"], [PLACE[2]], "slot", cell_of=cell)
    keys = keys.select(F.col(PLACE[1]).alias("__gw_key_file"), F.col(PLACE[2]).alias("__gw_key_at"), *COLUMNS[:4], F.col("slot").cast("long"), "grown_shard")
    same = (F.col(PLACE[1]) == F.col("__gw_key_file")) & (F.col(PLACE[2]) == F.col("__gw_key_at"))
    kept = [c for c in docs.columns if c.lower() not in COLUMNS]
    return rows.select(*[f"`{c}`" for c in kept], *PLACE).join(keys, same).select(*[f"`{c}`" for c in kept], *COLUMNS)
