"""Tags: why an intron is left out, which of equal introns stands for the others, which isoform is the longest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.dna import longest_run, valid_bases
from helixframe.operators.relational import overlapping


def first_match(rules: Sequence[tuple[str, Column]]) -> Column:
    """The tag of the first rule that holds; null if none does."""
    out = None
    for tag, holds in rules:
        out = F.when(holds, F.lit(tag)) if out is None else out.when(holds, F.lit(tag))
    return out


def omission(min_length: int, bp_length: int, regions: Sequence[str], allow_noncanonical: bool, allow_overlap: bool, longest_only: bool, isoform: Column | None = None, overlap: Column | None = None) -> Column:
    """s short, a ambiguous, n noncanonical, i not the longest isoform, v overlapping; the first that holds. P2.

    isoform and overlap are unknown in the first pass, which thus gives s, a or n only. P3.
    """
    run = longest_run(F.col("bp_region_seq"), "ACGT")
    scored = F.lit(False)
    for r in ("five", "three"):
        if r in regions:
            scored = scored | F.coalesce(~valid_bases(F.col(f"{r}_seq")), F.lit(False))
    rules = [("s", F.col("length") < min_length), ("a", scored)]
    rules += [("s", (run < bp_length) & (F.length("bp_region_seq") < bp_length)), ("a", run < bp_length)] if "bp" in regions else []
    if not allow_noncanonical:
        rules.append(("n", F.col("noncanonical")))
    if longest_only and isoform is not None:
        rules.append(("i", isoform == F.lit(False)))
    if not allow_overlap and overlap is not None:
        rules.append(("v", overlap.isNotNull()))
    return first_match(rules)


def hierarchical_order() -> list[Column]:
    """CDS-defined first, then longest parent, its name, largest family, place in it, line; number breaks ties. W5."""
    return [F.asc("defined_by"), F.desc("parent_length"), F.asc("transcript"), F.desc("family_size"), F.asc("idx"), F.asc("line_number"), F.asc("intron_id")]


def tag_duplicates(introns: DataFrame) -> DataFrame:
    """duplicate: intron_id of the first intron with the same place, strand and usability; null for that one. W3."""
    same = Window.partitionBy("region", "strand", F.col("omit1").isNull(), "start", "stop").orderBy(*hierarchical_order())
    winner = F.first("intron_id").over(same)
    return introns.withColumns({"winner": winner}).withColumns({"duplicate": F.when(F.col("winner") != F.col("intron_id"), F.col("winner"))}).drop("winner")


def tag_longest_isoform(introns: DataFrame) -> DataFrame:
    """Whether the intron's transcript is the first met of its gene, in contig and hierarchical order. W4."""
    met = Window.partitionBy("gene").orderBy(F.asc("region_order"), *hierarchical_order())
    return introns.withColumns({"longest_isoform": F.col("transcript").eqNullSafe(F.first("transcript").over(met))})


def tag_overlaps(introns: DataFrame, width: int = 10_000) -> DataFrame:
    """overlap: among introns of lesser rank on the same strand that are no duplicates, the leftmost one met; W6.

    Looked for only for introns that are usable, no duplicate and not of the longest isoform.
    """
    rank = F.row_number().over(Window.partitionBy("region", "strand").orderBy(*hierarchical_order()))
    ranked = introns.withColumns({"rank": rank})
    asks = ranked.where("duplicate is null and omit1 is null and not longest_isoform").select("region", "strand", "start", "stop", "rank", "intron_id")
    kept = ranked.where("duplicate is null and omit1 is null").select("region", "strand", F.col("start").alias("b_start"), F.col("stop").alias("b_stop"), F.col("rank").alias("b_rank"), F.col("intron_id").alias("b_id"))
    met = overlapping(asks, kept, ["region", "strand"], ("start", "stop"), ("b_start", "b_stop"), width).where("b_rank < rank")
    first = met.groupBy("intron_id").agg(F.min_by("b_id", F.struct("b_start", "b_stop", "b_id")).alias("overlap"))
    return ranked.drop("rank").join(first, "intron_id", "left")
