"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest node of its component.

    Each round moves every edge closer to the smallest node it can see; the
    edges of a finished component form one star. Nothing of the graph reaches the driver.
    Nodes of very many neighbours meet them by broadcast, so that no task gets all edges of a large star.
    """
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    while True:
        edges = materialize(_small(_large(edges)))
        if not _unfinished(edges).head(1):
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _unfinished(edges: DataFrame) -> DataFrame:
    """Nodes that point to two others, or that point on and are pointed at: none in a forest of stars."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 OR (out = 1 AND into = 1)")


def _large(edges: DataFrame) -> DataFrame:
    """Links the larger neighbours of each node to its smallest neighbour or itself."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("size"))
    return hot_join(both, materialize(least), "u", 2 * edges.count()).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them."""
    edges = materialize(edges)
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")))
    moved = hot_join(edges, least, "u", edges.count()).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", "m")).distinct()
