"""Connected components of a table of links, by alternating large-star and small-star steps; no step gathers a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (only the smaller ones if not large) are tied to the least of them and itself."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-least")
    tied = edges.join(least, "u")
    if large:
        pairs = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        pairs = tied.select("v", "m").union(least.select("u", "m")).toDF("u", "v")
    out = written(pairs.where("u <> v").distinct(), "star-edges")
    dropped(least)
    return out


def components(links: DataFrame) -> DataFrame:
    """For every node of the links (u, v: long) but each component's least: u, and that least node as v. No links, no rows."""
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star-edges")
    while True:
        n, nodes = edges.agg(F.count("*"), F.count_distinct("u")).first()
        inner = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        if n == nodes and inner.isEmpty():
            return edges
        once = star(edges, True)
        again = star(once, False)
        dropped(edges)
        dropped(once)
        edges = again
