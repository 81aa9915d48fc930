"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a partial aggregation and an equi-join; a node with many edges is split by adaptive execution. No edge
leaves the cluster. Steps are written to the shared folder, so lineage stays short and no executor is needed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import settle


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Each child has one parent, and no parent is a child."""
    parents = edges.groupBy("child").agg(F.count("*").alias("n"))
    if not parents.where("n > 1").limit(1).isEmpty():
        return False
    return edges.select("parent").distinct().join(edges.select(F.col("child").alias("parent")), "parent", "left_semi").limit(1).isEmpty()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) for every node that the links (a, b) touch; component is its smallest node."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct()
    edges = settle(edges, name)
    while not _is_forest_of_stars(edges):
        both = edges.select(F.col("child").alias("u"), F.col("parent").alias("v")).union(edges.select(F.col("parent").alias("u"), F.col("child").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("child"), F.col("m").alias("parent")).distinct()
        large = settle(large.where("child <> parent"), name)
        least = large.groupBy("child").agg(F.min("parent").alias("m"))
        small = large.join(least, "child").where("parent <> m").select(F.col("parent").alias("child"), F.col("m").alias("parent"))
        edges = settle(small.union(least.select("child", F.col("m").alias("parent"))).distinct(), name)
    roots = edges.select(F.col("parent").alias("node")).distinct()
    return edges.select(F.col("child").alias("node"), F.col("parent").alias("component")).union(roots.select("node", F.col("node").alias("component")))
