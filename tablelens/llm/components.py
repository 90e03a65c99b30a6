"""Connected components of an edge table, spread over the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end of an edge (a < b) has one edge only, and is never a smaller end."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.lit(0).alias("up")), F.struct(F.col("b").alias("node"), F.lit(1).alias("up")))).alias("e"))
    per_node = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("low"))
    return per_node.where("up > 1 OR (up = 1 AND low = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes in `edges` (a, b); the component is its smallest node.

    Alternating stars: every node points its larger neighbours, then its smaller ones, at the least it knows, until
    each edge joins a node to its root. A hot root's neighbours are summed up by partial minima; each round is
    written to the shared folder, and the rounds grow with the logarithm of the nodes."""
    edges = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("a").alias("b"), F.col("b").alias("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b")
        large = stage(large.where("a <> b").distinct())
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        edges = stage(small.where("a <> b").distinct())
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())
