"""Mixing sources to target weights: Pfair scheduling of source blocks, native DataFrame operations only.

Each source's documents form blocks of `block_rows`. Block k (from 1) of a source with weight w of W is released at slot
floor((k-1) W / w) and due at ceil(k W / w); at each slot the released block with the earliest deadline goes next. With one
block a slot, this keeps every source within less than one block of its share at every slot. The pattern repeats after W
slots, so one period is enough for any number of blocks. When a source has no block left, a new phase starts with the
others' weights; nothing is dropped or repeated.

The schedule is made on the driver as pieces: a source, its first block, the first slot, and the slots of one period. It holds no more
of it than `most` entries at a time; a larger one is written to the shared folder in parts and joined by shuffle. Each piece stands in
every cell of CELL blocks that it covers, so the join is on source and cell and no source meets in one task.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLACE, numbered, shared_dir, with_place, written

MAX_PATTERN = 1 << 20  # most entries of patterns that are broadcast, or held by the driver
CELL = 1 << 12
PIECES = "gw_source string, gw_cell bigint, gw_k0 bigint, gw_k1 bigint, gw_base bigint, gw_period bigint, gw_each bigint, gw_at array<int>"


def period(weights: dict[str, int], order: list[str], slots: int | None = None, left: dict[str, int] | None = None) -> list[str]:
    """The sources of successive slots: one full period, or less where a source with `left` blocks runs out first.

    Blocks wait by release slot; of those released, the earliest deadline goes first, and of equal ones the first in order.
    """
    total, done, out = sum(weights.values()), dict.fromkeys(order, 0), []
    waiting, ready = [(0, i) for i in range(len(order))], []
    for t in range(total if slots is None else slots):
        while waiting and waiting[0][0] <= t:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[order[i]] + 1) * total // weights[order[i]]), i))
        i = heapq.heappop(ready)[1]
        s = order[i]
        done[s] += 1
        out.append(s)
        if left is not None and done[s] == left[s]:
            break
        heapq.heappush(waiting, (done[s] * total // weights[s], i))
    return out


def pieces(blocks: dict[str, int], weights: dict[str, int]) -> Iterator[tuple[str, tuple[int, int, int, int, list[int]], int]]:
    """Source, piece (first block, first slot, period, blocks a period, slots within the period) and blocks of the piece, in the order of slots."""
    left, first, base = dict(blocks), dict.fromkeys(blocks, 0), 0
    while active := sorted(s for s in left if left[s] > 0):
        w = {s: weights[s] for s in active}
        full = min(left[s] // w[s] for s in active)
        pattern = period(w, active) if full else period(w, active, left=left)
        places: dict[str, list[int]] = {}
        for i, s in enumerate(pattern):
            places.setdefault(s, []).append(i)
        times = max(full, 1)
        for s, at in places.items():
            yield s, (first[s], base, len(pattern), len(at), at), len(at) * times
            first[s] += len(at) * times
            left[s] -= len(at) * times
        base += len(pattern) * times


def schedule(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple[str, list[tuple[int, int, int, int, list[int]]]]]:
    """All pieces of every source."""
    out: dict[str, list] = {s: [] for s in blocks}
    for s, piece, _ in pieces(blocks, weights):
        out[s].append(piece)
    return list(out.items())


def plan_table(docs: DataFrame, blocks: dict[str, int], weights: dict[str, int], most: int) -> tuple[DataFrame, bool]:
    """The pieces by source and cell of blocks, and whether they are few enough to be broadcast."""
    spark, held, entries, path = docs.sparkSession, [], 0, None
    for s, (k0, base, length, each, at), n in pieces(blocks, weights):
        for cell in range(k0 // CELL, (k0 + n - 1) // CELL + 1):
            held.append((s, cell, k0, k0 + n, base, length, each, at))
            entries += len(at)
        if entries > most:
            path = path or f"{shared_dir(spark)}/mix-pieces-{uuid.uuid4().hex}"
            spark.createDataFrame(held, PIECES).write.mode("append").parquet(path)
            held, entries = [], 0
    if path is None:
        return spark.createDataFrame(held, PIECES), True
    if held:
        spark.createDataFrame(held, PIECES).write.mode("append").parquet(path)
    return spark.read.schema(PIECES).parquet(path), False


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block_rows: int = 64, default_weight: int = 1, most: int = MAX_PATTERN) -> DataFrame:
    """Interleave all rows of `docs` (doc_id, source) by integer target weights; sources without one take `default_weight`.

    Adds gw_block (number of the block within its source), gw_slot (its place in the mix) and gw_place (the row within the
    block), in place of columns of these names; the mix is the order by gw_slot, gw_place. A null source is a source of its own; rows
    without an id or repeated keep a place each; an empty table gives no rows. Other columns stay as they are.
    """
    weights = weights or {}
    if any(int(w) != w or w < 1 for w in [*weights.values(), default_weight]):
        raise ValueError("weights are integers of 1 or more")
    docs = docs.drop("gw_block", "gw_slot", "gw_place")
    name = F.coalesce(F.concat(F.lit("s"), docs["source"].cast("string")), F.lit(""))
    blocks = {r[0]: -(-r[1] // block_rows) for r in docs.groupBy(name).count().toLocalIterator()}
    table, few = plan_table(docs, blocks, {s: int(weights.get(s[1:] if s else None, default_weight)) for s in blocks}, most)
    ids = [c for c in ("doc_id", "text", *PLACE) if c in docs.columns]
    rows = numbered(docs.withColumn("__gw_source", name), ["__gw_source"], ids, "__gw_row", cell_of=F.pmod(F.xxhash64("doc_id"), F.lit(1 << 12)).cast("int"))
    k = F.expr(f"__gw_row div {block_rows}")
    table = F.broadcast(table) if few else table
    here = (F.col("__gw_source") == table["gw_source"]) & (F.expr(f"__gw_row div {block_rows * CELL}") == table["gw_cell"]) & (k >= table["gw_k0"]) & (k < table["gw_k1"])
    since = k - table["gw_k0"]
    slot = table["gw_base"] + F.floor(since / table["gw_each"]) * table["gw_period"] + F.get(table["gw_at"], (since % table["gw_each"]).cast("int"))
    placed = [k.cast("long").alias("gw_block"), slot.cast("long").alias("gw_slot"), (F.col("__gw_row") % block_rows).cast("int").alias("gw_place")]
    return rows.join(table, here).select(*[rows[f"`{c}`"] for c in docs.columns], *placed)


def in_mix_order(docs: DataFrame, weights: dict[str, int] | None = None, **options) -> DataFrame:
    """All rows and columns of `docs`, partitions and the rows within them in the order of the mix.

    Only ids are scheduled. The rows move twice, to meet their slots and to the partition that holds their range of slots.
    """
    rows = with_place(docs)
    slots = mix(rows.select("doc_id", "source", *PLACE), weights, **options)
    slots = written(slots.select(F.col(PLACE[1]).alias("__gw_slot_file"), F.col(PLACE[2]).alias("__gw_slot_at"), "gw_slot", "gw_place").withColumnsRenamed({"gw_slot": "__gw_slot", "gw_place": "__gw_place"}), "mix-slots")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = (slots.agg(F.max("__gw_slot")).first()[0] or 0) // n + 1
    same = (F.col(PLACE[1]) == F.col("__gw_slot_file")) & (F.col(PLACE[2]) == F.col("__gw_slot_at"))
    placed = rows.join(slots, same).repartitionById(n, F.expr(f"__gw_slot div {each}").cast("int"))
    return placed.sortWithinPartitions("__gw_slot", "__gw_place").select(*[f"`{c}`" for c in docs.columns])
