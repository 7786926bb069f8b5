"""Road networks as edge tables: src, dst, cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import planar


def costs_from(edges: DataFrame, start, most_rounds: int = 1000) -> DataFrame:
    """Least cost and previous node of every node that can be reached from `start`: Bellman-Ford by frontiers.

    Each round joins only nodes whose cost fell in the last one; it ends when none did. Costs must not be negative.
    """
    spark = edges.sparkSession
    best = spark.createDataFrame([(start, 0.0, None)], f"node {edges.schema['src'].dataType.simpleString()}, cost double, prev {edges.schema['src'].dataType.simpleString()}")
    front, steps = best, edges.select("src", "dst", F.col("cost").cast("double").alias("step"))
    for _ in range(most_rounds):
        reached = front.join(steps, front["node"] == steps["src"]).select(F.col("dst").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), F.col("src").alias("prev"))
        reached = reached.groupBy("node").agg(F.min(F.struct("cost", "prev")).alias("r")).select("node", "r.*")
        old = best.select(F.col("node").alias("o"), F.col("cost").alias("oc"))
        front = reached.join(old, F.col("node") == F.col("o"), "left").where("oc is null or cost < oc").select("node", "cost", "prev").checkpoint()
        if front.isEmpty():
            return best
        best = best.unionByName(front).groupBy("node").agg(F.min(F.struct("cost", "prev")).alias("r")).select("node", "r.*").checkpoint()
    raise ValueError("no end within the given rounds")


def path(edges: DataFrame, start, end) -> list:
    """Nodes of a shortest route, or none. The way back is as long as the route."""
    best, node, out = costs_from(edges, start), end, []
    while node is not None:
        row = best.where(F.col("node") == node).first()
        if row is None:
            return []
        out.append(node)
        node = row["prev"]
    return out[::-1]


def linked(lines: DataFrame, digits: int = 6) -> DataFrame:
    """Edges both ways (src, dst, cost) from segments (x1, y1, x2, y2, speed): nodes are points rounded to `digits`, cost is length over speed."""
    node = lambda x, y: F.concat_ws(",", F.format_number(F.col(x), digits), F.format_number(F.col(y), digits))
    cost = F.sqrt(planar.distance2("x1", "y1", "x2", "y2")) / F.col("speed")
    one = lines.select(node("x1", "y1").alias("src"), node("x2", "y2").alias("dst"), cost.alias("cost"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost")).groupBy("src", "dst").agg(F.min("cost").alias("cost"))


def nearest_node(nodes: DataFrame, x: float, y: float) -> DataFrame:
    """The node (node, x, y) nearest to a point on the plane; of equal ones the least."""
    return nodes.withColumn("distance", F.sqrt(planar.distance2(F.lit(x), F.lit(y), "x", "y"))).orderBy("distance", "node").limit(1)
