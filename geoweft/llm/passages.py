"""Substring dedup: lines and their sentences are hashed, and only the earliest occurrence of each in the corpus stays.

A unit is a line, or a sentence of a line where the line holds several (a sentence ends with . ! or ? before a space), so a repeated
passage is found where it stands in the middle of other text. Units are normalised (lower case, single spaces) and grouped by a
128-bit digest over all documents. The occurrence with the least (doc_id, unit number) stays. Later ones are removed where a run of
them, one after the other, has at least `min_words` words; with `short_lines` (as in the query) those of a whole line go whatever its
length, so only short common sentences within longer lines stay. Offsets are those of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written

UNIT = re.compile(r"[^\s][^\n]*?(?:[.!?]+(?=\s)|(?=\n)|\Z)")
UNITS = "doc_id bigint, row_key bigint, unit int, start int, stop int, words int, whole int, high bigint, low bigint"


def lines(text: str) -> Iterator[list[tuple[int, int, list[str]]]]:
    """The units of each line that is not blank: start, stop and words."""
    line: list[tuple[int, int, list[str]]] = []
    for m in UNIT.finditer(text):
        if line and text.find("\n", line[-1][1], m.start()) >= 0:
            yield line
            line = []
        line.append((m.start(), m.end(), m[0].lower().split()))
    if line:
        yield line


def units(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """Every unit of docs (doc_id, text): its number, offsets in characters, words, whole (1 for a line) and digest (high, low).

    A line of several sentences has a row of its own as well, if it has fewer than `min_words` words: the number of its first unit, and
    the count of its units as `whole`. Null and blank texts have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in (x for whole in batches for x in slices(whole)):
            cols: list[list] = [[] for _ in range(9)]
            add = [c.append for c in cols]
            for d, k, t in zip(b.column("doc_id").to_pylist(), b.column("row_key").to_pylist(), b.column("text").to_pylist(), strict=True):
                i = 0
                for line in lines(t or ""):
                    n = len(line)
                    rows = [(i + j, a, b, w, int(n == 1)) for j, (a, b, w) in enumerate(line)]
                    if n > 1 and sum(len(w) for _, _, w in line) < min_words:
                        rows.append((i, line[0][0], line[-1][1], [x for _, _, w in line for x in w], n))
                    i += n
                    for u, a, b, w, whole in rows:
                        h = digest(" ".join(w))
                        for f, x in zip(add, (d, k, u, a, b, len(w), whole, int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)), strict=True):
                            f(x)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in UNITS.split(", ")])

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(run, UNITS)


def repeated(docs: DataFrame, min_words: int = 10, short_lines: bool = False) -> DataFrame:
    """The runs to remove: doc_id, row_key, start, stop (characters), units, words, and where the first unit stays (kept_doc_id, kept_start).

    Rows that are equal in doc_id and text count as one document; rows with one doc_id and different texts are told apart by row_key, and
    null ids rank last. Empty tables give no rows; columns other than doc_id and text are not read.
    """
    found = written(units(docs, min_words if short_lines else 0).where("words > 0"), "passage-units")
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row_key", "unit", "start")
    firsts = found.groupBy("high", "low").agg(F.min(rank).alias("kept"), F.max(rank).alias("last")).where("kept <> last").drop("last")
    firsts = written(firsts, "passage-firsts")
    again = found.join(firsts, ["high", "low"]).where(~(F.col("row_key") == F.col("kept.row_key")) | ~(F.col("unit") == F.col("kept.unit")))
    again = again.select("doc_id", "row_key", "unit", "start", "stop", "words", "whole", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"))
    again = again.withColumn("line", F.col("whole") > 1).dropDuplicates(["row_key", "unit", "line"])
    nth = Window.partitionBy("row_key").orderBy("unit", F.col("line").desc())
    so_far = nth.rowsBetween(Window.unboundedPreceding, 0)
    again = again.withColumn("run", F.col("unit") - F.sum((~F.col("line")).cast("int")).over(so_far)).withColumn("upto", F.max(F.when(F.col("line"), F.col("unit") + F.col("whole"))).over(so_far)).where(~F.col("line"))
    again = again.withColumn("total", F.sum("words").over(Window.partitionBy("row_key", "run")))
    again = again.where((F.col("total") >= min_words) | (F.lit(short_lines) & ((F.col("whole") == 1) | (F.col("upto") > F.col("unit")))))
    nth = Window.partitionBy("row_key").orderBy("unit")
    runs = again.withColumn("run", F.col("unit") - F.row_number().over(nth)).groupBy("row_key", "run").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").cast("int").alias("units"), F.sum("words").cast("int").alias("words"),
        F.min(F.struct("unit", "kept_doc_id", "kept_start")).alias("kept"),
    )
    return runs.select("doc_id", "row_key", "start", "stop", "units", "words", "kept.kept_doc_id", "kept.kept_start")


def without_repeats(docs: DataFrame, min_words: int = 10, short_lines: bool = False) -> DataFrame:
    """The documents, all columns, with gw_clean (the text without later occurrences) and gw_spans (removed start, stop offsets, in order).

    These replace columns of the same names; all others stay as they are.
    """
    docs = docs.drop("gw_clean", "gw_spans")
    cut = repeated(docs, min_words, short_lines).groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("gw_spans"))
    rows = docs.join(cut, F.xxhash64(docs["doc_id"], docs["text"]) == cut["row_key"], "left").select(*[docs[f"`{c}`"] for c in docs.columns], cut["gw_spans"])
    none = F.array().cast("array<struct<start:int,stop:int>>")
    spans = F.coalesce("gw_spans", none)
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    kept = F.aggregate(spans, start, lambda s, x: F.struct(F.concat(s["text"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"])).alias("text"), x["stop"].alias("at")))
    kept = F.concat(kept["text"], F.substring(F.col("text"), kept["at"] + 1, F.length("text")))
    return rows.withColumn("gw_clean", F.when(F.size(spans) == 0, F.col("text")).otherwise(kept)).withColumn("gw_spans", spans)
