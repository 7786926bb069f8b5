"""One query for each operator, over the whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, hmm, media, mixing, passages, quality, secretscan, sharding, simhash, toxicity
from .common import table, written

#: Target weights of the sources; every other source has weight 1.
MIX_WEIGHTS = {"src0": 6, "src1": 3, "src2": 3, "src3": 2, "src4": 2}


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = written(quality.feature_table(table(spark, sf_dir, "documents")), "quality-features")
    scores = quality.scored_table(features, quality.cotrained(features, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", *[scores[c].alias(c.removeprefix("gw_")) for c in quality.ADDED])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    corpus = secretscan.learned(docs)
    forest = secretscan.grown(secretscan.example_findings(spark, words=corpus.frequent), corpus)
    return secretscan.scanned(docs, forest)


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, MIX_WEIGHTS).select("doc_id", "source", "gw_block", "gw_slot", "gw_place")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.toxicity(docs, *toxicity.fit(docs, labels.where(~toxicity.held_out())))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("gw_text")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"), short_lines=True).drop("row_key")


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_scores(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


QUERIES = {"op1_shard": op1_shard, "op2_quality": op2_quality, "op3_secrets": op3_secrets, "op4_mix": op4_mix, "op5_toxicity": op5_toxicity, "op6_decontaminate": op6_decontaminate, "op7_simhash": op7_simhash, "op8_passages": op8_passages, "op9_hmm": op9_hmm, "op10_media": op10_media}
#: Of the items, which all have five words or more: every window with an aligned shared shingle, its multiset similarity, and the best start.
DECONTAMINATION_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t-\\r]+'), lambda w: w <> '') AS w FROM documents),
ds AS (SELECT doc_id, len(w) - 4 AS m, unnest(range(0, greatest(len(w) - 4, 0))) AS p, w FROM d),
s AS (SELECT doc_id, m, p, array_to_string(list_slice(w, p + 1, p + 5), ' ') AS sh FROM ds),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t-\\r]+'), lambda w: w <> '') AS w FROM benchmark),
bs AS (SELECT item_id, len(w) - 4 AS n, unnest(range(0, greatest(len(w) - 4, 0))) AS o, w FROM b),
i AS (SELECT item_id, n, o, array_to_string(list_slice(w, o + 1, o + 5), ' ') AS sh FROM bs),
c AS (SELECT DISTINCT s.doc_id, i.item_id, n, m, greatest(0, least(p - o, m - n)) AS start FROM s JOIN i USING (sh)),
win AS (SELECT c.doc_id, item_id, n, c.m, start, sh, count(*) AS k FROM c JOIN s ON s.doc_id = c.doc_id AND s.p >= start AND s.p < start + n GROUP BY ALL),
ic AS (SELECT item_id, sh, count(*) AS k FROM i GROUP BY ALL),
x AS (SELECT doc_id, item_id, n, m, start, sum(least(win.k, ic.k)) AS common FROM win JOIN ic USING (item_id, sh) GROUP BY ALL),
y AS (SELECT doc_id, item_id, start, CAST(common AS DOUBLE) / CAST(least(n, m - start) + n - common AS DOUBLE) AS similarity FROM x)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start_word, similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS nth FROM y WHERE similarity >= 0.8) WHERE nth = 1
"""
ORACLE_SQL: dict[str, str] = {"op6_decontaminate": DECONTAMINATION_SQL}
