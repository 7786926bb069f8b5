"""A training corpus from the documents table: each stage works on what the one before it kept.

run(spark, sf_dir) applies all stages; each one's result is written as Parquet in the shared folder and read again, so a lost
executor costs at most the stage that runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoweft.llm import decontamination, mixing, quality, sharding, similarity
from geoweft.llm.common import removed, scratch, shared_dir, table
from geoweft.llm.queries import MIX_WEIGHTS


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    model = quality.cotrain(docs, table(spark, sf_dir, "labels"))
    return quality.judged(docs, model).where("gw_keep").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more, over SimHash bit planes."""
    return similarity.first_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: ranges of it by file, and sorted within."""
    return mixing.in_mix_order(docs, MIX_WEIGHTS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot; within a shard, slots follow the mix."""
    return sharding.sharded_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", clean_of_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The classifier's training cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus: the documents that all stages keep, with shard and slot. Tables of a stage are deleted when the next one's result stands."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch():
            kept = stage(spark, docs, sf_dir)
            path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs
