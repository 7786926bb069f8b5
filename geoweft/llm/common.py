"""Helpers shared by the training-data operators: tables in the shared folder, gapless numbers, tokens."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a local one only where that is unset and all executors are threads of this process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="geoweft-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Tables written within scratch().
_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes, at its end, every table that was written within it; what is to stay is written after it."""
    _scratch.append([])
    try:
        yield
    finally:
        for df in _scratch.pop():
            dropped(df)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder: lineage ends there and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._gw_path = path
    if _scratch:
        _scratch[-1].append(out)
    return out


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(df: DataFrame) -> None:
    """Delete a table that written() made, once nothing needs it."""
    removed(df.sparkSession, df._gw_path)


#: Where a row stands in a written table: number and name of its file, and row within the file.
PLACE = ("__gw_part", "__gw_file", "__gw_at")


def with_place(docs: DataFrame) -> DataFrame:
    """The rows with PLACE, which tells them apart and gives their order; a table that isn't read from files is written first."""
    docs = docs if docs.inputFiles() else written(docs, "placed")
    part = F.regexp_extract("_metadata.file_name", "part-([0-9]+)", 1).cast("long")
    return docs.select("*", part.alias(PLACE[0]), F.col("_metadata.file_name").alias(PLACE[1]), F.col("_metadata.row_index").alias(PLACE[2]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, groups: list[str], order: list[str], out: str, micro: int = 4096, cell_of: Column | None = None) -> DataFrame:
    """Add `out`, a gapless number from 0 within each value of `groups`, without bringing a group into one task.

    Rows are dealt into `micro` hash cells a group by the `order` columns; cells get their first number from a prefix sum
    over cell counts (at most `micro` rows a group), rows get theirs from row_number within the cell. Cells `cell_of` that rise with
    the order make the numbers rise with it too.
    """
    cell, first = "__gw_cell", "__gw_first"
    df = df.withColumn(cell, F.pmod(F.xxhash64(*order), F.lit(micro)).cast("int") if cell_of is None else cell_of)
    keys = [*groups, cell]
    before = Window.partitionBy(*groups).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    firsts = df.groupBy(*keys).agg(F.count("*").alias("__gw_n")).withColumn(first, F.coalesce(F.sum("__gw_n").over(before), F.lit(0)))
    firsts = firsts.select(*[F.col(k).alias(f"__gw_r{i}") for i, k in enumerate(keys)], first)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__gw_r{i}"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("__gw_i", F.row_number().over(inside) - 1)
    return rows.join(firsts, same).withColumn(out, F.col(first) + F.col("__gw_i")).drop(cell, first, "__gw_i", *[f"__gw_r{i}" for i in range(len(keys))])


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def flat_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words [^\\x20\\x09-\\x0D]+ of the texts (nulls: none) in one array, and each text's first position (one more at the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    texts = texts.take(pa.array(np.arange(len(texts)))) if texts.offset else texts
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        at = np.concatenate(([0], np.cumsum(full)))[at]
        flat = flat.filter(pa.array(full))
    return flat, at


def hashed_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """XXH64 (seed 42, signed) of each distinct word, the index of each word among these, and the texts' first positions."""
    flat, at = flat_words(texts, lower)
    coded = flat.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    uniq = np.fromiter((digest(w, 42) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary)).view(np.int64)
    return uniq, coded.indices.to_numpy(), at


def summed(df: DataFrame, key: str = "idx", value: str = "val") -> dict[int, float]:
    """Sum (idx, val) rows that tasks emitted; as many results as the model has parameters."""
    return {r[0]: r[1] for r in df.groupBy(key).agg(F.sum(value)).collect()}


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 6_000_000) -> list[pa.RecordBatch]:
    """The batch in pieces of about so many bytes of text (one row at least); copies, as kernels misread strings of an array with an offset."""
    if not batch.num_rows:
        return []
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0]
    while cuts[-1] < len(size):
        before = size[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(size, before + most, side="right"))))
    return [batch.take(pa.array(np.arange(a, b))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
