"""STAC documents: flat items and counts."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LINKS = "array<struct<rel: string, href: string, type: string, title: string>>"


def read_stac(spark: SparkSession, path: str) -> DataFrame:
    """One row a document: doc (JSON), url."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"), F.input_file_name().alias("url"))


def resource_type(doc: Column) -> Column:
    """item, collection, catalog, or api collections and item lists by their members."""
    at = lambda p: F.get_json_object(doc, p)
    return F.when(at("$.type") == "Feature", "item").when(at("$.type") == "Collection", "collection").when(at("$.type") == "Catalog", "catalog").when(at("$.type") == "FeatureCollection", "item_list").when(at("$.collections").isNotNull(), "collection_list")


def flat(docs: DataFrame) -> DataFrame:
    """Core columns of STAC documents (doc): id, type, version, datetime, collection, bbox, links, assets, extensions."""
    at = lambda p: F.get_json_object("doc", p)
    asset = "map<string, struct<href: string, title: string, description: string, type: string, roles: array<string>>>"
    return docs.select(
        at("$.id").alias("id"), resource_type(F.col("doc")).alias("type"), at("$.stac_version").alias("version"), F.to_timestamp(at("$.properties.datetime")).alias("datetime"), at("$.collection").alias("collection"),
        F.from_json(at("$.bbox"), "array<double>").alias("bbox"), F.from_json(at("$.links"), LINKS).alias("links"), F.from_json(at("$.assets"), asset).alias("assets"), F.from_json(at("$.stac_extensions"), "array<string>").alias("extensions"),
        F.from_json(at("$.conformsTo"), "array<string>").alias("conforms"), "doc",
    )


def link(links: Column, rel: str, media: list[str] | None = None) -> Column:
    """The first link of a relation, of one of the media types if given."""
    test = lambda x: (x["rel"] == rel) & (x["type"].isin(media) if media else F.lit(True))
    return F.get(F.filter(links, test), 0)


@F.pandas_udf(StringType())
def resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    """Absolute form of a link."""
    return pd.Series([urljoin(b or "", h) if h is not None else None for b, h in zip(base, href, strict=True)], dtype=object)


def statistics(items: DataFrame) -> DataFrame:
    """Counts by type of: documents, versions, extensions, asset types and conformance classes (kind, type, name, n)."""
    one = lambda kind, name: items.select(F.lit(kind).alias("kind"), "type", name.alias("name"))
    parts = [one("document", F.lit("all")), one("version", F.col("version")), one("extension", F.explode("extensions")), one("asset", F.explode(F.transform(F.map_values("assets"), lambda a: a["type"]))), one("conformance", F.explode("conforms"))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("kind", "type", "name").agg(F.count("*").alias("n"))


def problems(items: DataFrame) -> DataFrame:
    """Documents that miss a required member (offline part of validation): id, missing."""
    need = {"id": F.col("id").isNull(), "stac_version": F.col("version").isNull(), "links": F.col("links").isNull(), "type": F.col("type").isNull(), "assets": (F.col("type") == "item") & F.col("assets").isNull()}
    missing = F.filter(F.array(*[F.when(test, F.lit(n)) for n, test in need.items()]), lambda x: x.isNotNull())
    return items.withColumn("missing", missing).where(F.size("missing") > 0).select("id", "missing")
