"""Reports as headerless tab-separated text. K1-K12."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.config import Config
from helixframe.functions.report import bps_context, label, motif_string, tsv
from helixframe.operators.training import position_marks


def meta(introns: DataFrame) -> DataFrame:
    """K2: omitted introns first, then scored ones."""
    motif = motif_string(F.substring("upstream_flank", -3, 3), F.col("five_display"), F.col("bp_seq"), F.col("bp_seq_u2"), F.col("three_display"), F.substring("downstream_flank", 1, 3))
    context = F.when(F.col("bp_seq").isNotNull(), bps_context(F.col("bp_region_seq"), F.col("bp_seq"), F.col("bp_start")))
    line = tsv("name", F.round("relative_score", 4), "dnts", motif, context, "length", "transcript", "gene", "idx", "family_size", "fractional_position", "phase", "type_id", "defined_by")
    return introns.orderBy(F.col("omitted").isNull(), "svm_score", "transcript", "idx").select(line.alias("value"))


def bed(introns: DataFrame) -> DataFrame:
    """K3."""
    return introns.orderBy(F.col("omitted").isNull(), "region", "start").select(tsv("region", F.col("start") - 1, "stop", label(F.col("name"), F.col("relative_score")), "svm_score", "strand").alias("value"))


def introns_file(introns: DataFrame) -> DataFrame:
    """K4, K5: the score is joined before writing."""
    return introns.select(tsv("name", F.round("svm_score", 4), "upstream_flank", "seq", "downstream_flank").alias("value"))


def score_info(introns: DataFrame) -> DataFrame:
    """K6, O1."""
    cols = ["name", "relative_score", "svm_score", "score_distance", "five_seq", "five_raw", "five_z", "bp_seq", "bp_seq_u2", "bp_raw", "bp_z", "three_seq", "three_raw", "three_z"]
    return introns.where("svm_score is not null").orderBy("svm_score", "transcript", "idx").select(tsv(*cols).alias("value"))


def superseded(introns: DataFrame, by: str) -> DataFrame:
    """K7 (by='duplicate') and K8 (by='overlap'): kept name, superseded name. J7."""
    kept = introns.select(F.col("intron_id").alias("kept_id"), F.col("name").alias("kept"))
    return introns.where(F.col(by).isNotNull()).join(kept, F.col(by) == F.col("kept_id")).select(tsv("kept", "name").alias("value"))


def demoted(introns: DataFrame, regions: Sequence[str] = ("five", "bp", "three")) -> DataFrame:
    """K11: name, score and z-scores before, and after demotion, with five decimals."""
    of = lambda total, parts: F.format_string("%.5f (" + ", ".join(["%.5f"] * len(parts)) + ")", total, *parts)
    was = of(F.col("was.svm_score"), [F.col(f"was.{r}_z") for r in regions])
    now = of(F.col("svm_score"), [F.col(f"{r}_z") for r in regions])
    return introns.where("demoted").orderBy("svm_score").select(F.concat("name", F.lit("\t"), was, F.lit(" --> "), now).alias("value"))


def pwm_score_info(introns: DataFrame, pwms: DataFrame, config: Config) -> DataFrame:
    """K12, O2: by score, four lines an intron: its name and score, then for the three regions the marks of the minor-type
    matrix, the sequence, and the marks of the major-type one, with the matrices' names last. F22."""
    one = pwms.withColumns({"v": F.min(F.coalesce("version", F.lit(""))).over(Window.partitionBy("subtype", "dnts", "region"))})
    one = one.where(F.coalesce("version", F.lit("")) == F.col("v"))
    key = ["subtype", "dnts", "region"]
    cells = F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", F.col("pos").cast("string"), "base").alias("k"), F.col("freq").alias("f"))))
    by_place = one.groupBy(*key, "pos").agg(F.max("freq").alias("most"), F.min("freq").alias("least")).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "most", "least"))).alias("p"))
    table = one.groupBy(*key).agg(cells.alias("cells")).join(by_place, key)
    named = table.select(F.concat_ws("_", "subtype", "dnts").alias("matrix"), "region", F.struct("cells", F.col("p.most").alias("most"), F.col("p.least").alias("least")).alias("m"))
    wide = named.groupBy("matrix").agg(F.map_from_entries(F.collect_list(F.struct("region", "m"))).alias("regions"))  # a row a matrix set
    sites = {"five": ("five_seq", config.five_coords[0]), "bp": ("bp_seq", 0), "three": ("three_seq", config.three_coords[0])}
    out = introns
    for kind in ("u12", "u2"):
        out = out.join(F.broadcast(wide.select(F.col("matrix").alias(f"{kind}_matrix"), F.col("regions").alias(f"{kind}_regions"))), f"{kind}_matrix", "left")

    def marks(kind: str) -> list:
        of = lambda r, f: F.col(f"{kind}_regions")[r][f]
        seq = {r: F.coalesce(F.col(c), F.lit("")) for r, (c, _) in sites.items()}
        return [F.coalesce(position_marks(seq[r], of(r, "cells"), of(r, "most"), of(r, "least"), s, config.missing), F.lit("")) for r, (_, s) in sites.items()]

    name = lambda kind: F.array_join(F.array(*[F.concat(F.replace(f"{kind}_matrix", F.lit("_"), F.lit("-")), F.lit(f"-{r}")) for r in sites]), ",")
    lines = [F.concat(F.lit(">"), "name", F.lit("\t"), F.col("svm_score").cast("string")), F.concat_ws("\t", *marks("u12"), name("u12")), F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("")) for c, _ in sites.values()], F.lit("")), F.concat_ws("\t", *marks("u2"), name("u2"))]
    return out.orderBy("svm_score", "name").select(F.concat_ws("\n", *lines).alias("value"))


def omission_counts(introns: DataFrame) -> DataFrame:
    """A12."""
    return introns.where("omitted is not null").groupBy("omitted").agg(F.count("*").alias("n"))


def noncanonical_counts(introns: DataFrame) -> DataFrame:
    """A13."""
    return introns.where("noncanonical and (omitted is null or omitted not in ('s', 'a'))").groupBy("dnts").agg(F.count("*").alias("n"))


def write(lines: DataFrame, path: str) -> None:
    """Replaces what an earlier run left there. K14."""
    lines.write.mode("overwrite").text(path)
