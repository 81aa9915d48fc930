"""Feature hierarchies: children meet parents by name, at every level, with partial aggregates and equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paths(roots: DataFrame, edges: DataFrame, levels: int) -> DataFrame:
    """(child, name, depth, path) of all nodes within so many levels of the roots. J1d.

    roots: child, name. edges: parent, child, name. A cycle isn't followed beyond `levels`.
    """
    at = roots.select("child", "name", F.lit(0).alias("depth"), F.col("name").alias("path"))
    out = at
    for depth in range(1, levels):
        step = edges.select(F.col("parent").alias("__parent"), F.col("child").alias("__child"), F.col("name").alias("__name"))
        at = at.join(step, F.col("child") == F.col("__parent")).select(F.col("__child").alias("child"), F.col("__name").alias("name"), F.lit(depth).alias("depth"), F.concat("path", F.lit("/"), F.col("__name")).alias("path"))
        out = out.unionByName(at)
    return out


def resolve(features: DataFrame) -> DataFrame:
    """Leaves (exon, cds) with the transcript they hang on and its gene. J1, J1d.

    features: one row for each parent of a line (sources.gff.normalise). A named parent needs no row of its own. The
    gene is the parent's parent, else the grandparent the leaf names, else the parent itself. Of several declarations of
    a name the one with the smallest line counts.
    """
    leaves = features.where(F.col("feat_type").isin("exon", "cds") & F.col("parent").isNotNull())
    declared = features.where(~F.col("feat_type").isin("exon", "cds") & F.col("name").isNotNull())
    first = declared.groupBy("name").agg(F.min_by("parent", "line_number").alias("above"), F.min_by("grandparent", "line_number").alias("above_grand"))
    met = leaves.join(first.select(F.col("name").alias("__declared"), "above", "above_grand"), F.col("parent") == F.col("__declared"), "left")
    gene = F.coalesce("above", F.when(F.col("grandparent") != F.col("parent"), F.col("grandparent")), "above_grand", "parent")
    return met.select("line_number", "region", "strand", "feat_type", "start", "stop", "phase", F.col("parent").alias("transcript"), gene.alias("gene"))


def with_lengths(leaves: DataFrame) -> DataFrame:
    """Adds parent_length: bases of the transcript's CDS if it has any, else of its exons. A1, A4."""
    size = F.col("stop") - F.col("start") + 1
    per = leaves.groupBy("transcript").agg(F.sum(F.when(F.col("feat_type") == "cds", size)).alias("cds"), F.sum(F.when(F.col("feat_type") == "exon", size)).alias("exon"))
    return leaves.join(per.select("transcript", F.coalesce("cds", "exon").cast("int").alias("parent_length")), "transcript")


def coding_order(leaves: DataFrame) -> DataFrame:
    """Adds sort keys k1, k2 that order the leaves of a transcript in coding direction. W2.

    Mixed strands follow the strand that all CDS rows share; without one, the lines' order.
    """
    w = Window.partitionBy("transcript")
    all_, cds = F.collect_set("strand").over(w), F.collect_set(F.when(F.col("feat_type") == "cds", F.col("strand"))).over(w)
    strand = F.when(F.size(all_) == 1, F.element_at(all_, 1)).when(F.size(cds) == 1, F.element_at(cds, 1))
    out = leaves.withColumns({"__strand": strand})
    k1 = F.when(F.col("__strand").isNull(), F.col("line_number")).when(F.col("__strand") == "-", -F.col("stop")).otherwise(F.col("start"))
    k2 = F.when(F.col("__strand").isNull(), F.lit(0)).when(F.col("__strand") == "-", -F.col("start")).otherwise(F.col("stop"))
    return out.withColumns({"k1": k1.cast("bigint"), "k2": k2.cast("bigint")}).drop("__strand")
