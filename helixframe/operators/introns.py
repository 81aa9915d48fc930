"""Introns from the exons and coding segments of transcripts. W1, W2, W7, W8, A2-A4, J6, P7."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.hierarchy import coding_order, resolve, with_lengths
from helixframe.operators.relational import overlapping, overlaps


def between(leaves: DataFrame) -> DataFrame:
    """The gaps between neighbours in coding order of a transcript's exons, and of its coding segments.

    Overlapping neighbours leave none; abutting ones a gap whose start is its stop + 1, of two bases by P1.
    """
    w = Window.partitionBy("transcript", "feat_type").orderBy("k1", "k2", "line_number")
    rows = coding_order(leaves).withColumns({"next": F.lead(F.struct("start", "stop", "line_number")).over(w)}).where("next is not null")
    rows = rows.where(~overlaps(F.col("start"), F.col("stop"), F.col("next.start"), F.col("next.stop")))
    start, stop = F.least("stop", "next.stop") + 1, F.greatest("start", "next.start") - 1
    size = F.col("stop") - F.col("start") + 1
    phase = F.pmod(size - F.col("phase"), F.lit(3)).cast("tinyint")
    return rows.select(
        "region", "strand", "transcript", "gene", "parent_length", F.col("feat_type").alias("defined_by"), start.alias("start"), stop.alias("stop"), phase.alias("phase"), ((F.col("line_number") + F.col("next.line_number")) / 2).alias("line_number"),
        F.struct("start", "stop", "line_number").alias("upstream_exon"), F.col("next").alias("downstream_exon"), "k1", "k2",
    )


def derive(features: DataFrame, asked: Sequence[str] = ("cds", "exon"), width: int = 10_000) -> DataFrame:
    """Introns of all transcripts with their place in them.

    Exon-defined introns count where no CDS-defined one of the transcript meets them. Places and family sizes come
    before the kinds that weren't asked for go (P7).
    """
    gaps = between(with_lengths(resolve(features)))
    by_cds, by_exon = gaps.where("defined_by = 'cds'"), gaps.where("defined_by = 'exon'")
    taken = by_cds.select("transcript", "region", "strand", F.col("start").alias("b_start"), F.col("stop").alias("b_stop"))
    rest = overlapping(by_exon, taken, ["transcript", "region", "strand"], ("start", "stop"), ("b_start", "b_stop"), width, "left_anti")
    w = Window.partitionBy("transcript")
    order = w.orderBy("k1", "k2", "line_number")
    size = F.col("upstream_exon.stop") - F.col("upstream_exon.start") + 1
    last = F.last(F.col("downstream_exon.stop") - F.col("downstream_exon.start") + 1).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = by_cds.unionByName(rest).withColumns({"idx": F.row_number().over(order), "family_size": F.count("*").over(w).cast("int")})
    run = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumns({"fractional_position": F.bround(run / (F.sum(size).over(w) + last) * 100, 3)})
    out = out.withColumns({"length": F.abs(F.col("start") - F.col("stop")) + 1})
    return out.where(F.col("defined_by").isin(*asked)).drop("k1", "k2")


def numbered(introns: DataFrame) -> DataFrame:
    """intron_id: a number from the intron's own fields, equal in every run. W10."""
    return introns.withColumns({"intron_id": F.xxhash64("region", "strand", "start", "stop", "transcript", "defined_by", "idx", "line_number")})
