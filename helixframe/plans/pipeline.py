"""The reference's three entries: a genome with an annotation or BED file, intron sequences, and the matrix builder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.config import Config
from helixframe.functions.dna import is_canonical
from helixframe.functions.report import abbreviate, intron_name, simple_name
from helixframe.operators import introns as intron_ops
from helixframe.operators import matrices, relational, scoring, sequences, svm, tagging
from helixframe.sources import bed, fasta, gff
from helixframe.sources import introns as intron_files
from helixframe.sources import pwm as pwm_files

KEY = ["subtype", "dnts", "region", "version"]


def _bed_introns(spark: SparkSession, config: Config) -> DataFrame:
    """BED intervals as introns without a transcript: all share one gene, so all count as its longest isoform."""
    rows = bed.read(spark, config.bed)
    none = F.lit(None).cast("string")
    return rows.select("region", "strand", none.alias("transcript"), none.alias("gene"), F.lit(0).alias("parent_length"), F.lit("bed").alias("defined_by"), "start", "stop", F.lit(None).cast("tinyint").alias("phase"), F.col("line_number").cast("double").alias("line_number"), F.lit(None).cast("int").alias("idx"), F.lit(None).cast("int").alias("family_size"), F.lit(None).cast("double").alias("fractional_position"), (F.col("stop") - F.col("start") + 1).alias("length"), F.col("name").alias("given_name"))


def _annotated(spark: SparkSession, config: Config) -> DataFrame:
    rows = gff.read(spark, config.annotation)
    asked = gff.usable_features(rows, config.features)
    return intron_ops.derive(gff.normalise(rows), asked).withColumns({"given_name": F.lit(None).cast("string")})


def extract(spark: SparkSession, config: Config, bp_width: int = 12) -> DataFrame:
    """Introns with sequences, tags, omission reasons and names: what -s reports. Entry A and B."""
    found = intron_ops.numbered(_bed_introns(spark, config) if config.bed else _annotated(spark, config))
    pieces = fasta.chunks(fasta.read(spark, config.genome), config.chunk)
    cut = sequences.assign(sequences.attach(found, pieces, config), config)
    if config.adjust_splice_sites and not config.bed:
        moved = sequences.corrected(sequences.splice_shift(cut))
        made = ["upstream_flank", "seq", "downstream_flank", "region_order", "five_seq", "three_seq", "bp_region_seq", "five_display", "three_display", "dnts", "noncanonical", "bp_offset"]
        again = sequences.assign(sequences.attach(moved.where("shift is not null").drop(*made), pieces, config), config)
        cut = moved.where("shift is null").unionByName(again)
    else:
        cut = cut.withColumns({"shift": F.lit(None).cast("int"), "corrected_tag": F.lit(None).cast("string")})
    least = config.least_length(bp_width)
    options = (least, bp_width, config.regions, config.allow_noncanonical, config.allow_overlap, config.longest_only)
    first = cut.withColumns({"omit1": tagging.omission(*options)})
    tagged = tagging.tag_longest_isoform(tagging.tag_duplicates(first))
    if config.allow_overlap or config.longest_only:
        tagged = tagged.withColumns({"overlap": F.col("duplicate")})
    else:
        tagged = tagging.tag_overlaps(tagged).withColumns({"overlap": F.coalesce("overlap", "duplicate")})
    out = tagged.withColumns({"omitted": tagging.omission(*options, F.col("longest_isoform"), F.col("overlap"))})
    return named(out, config)


def named(introns: DataFrame, config: Config) -> DataFrame:
    tags = F.filter(F.array(F.when(F.col("defined_by") == "exon", "[e]"), F.when(F.col("noncanonical"), "[n]"), F.when(~F.col("longest_isoform"), "[i]"), F.col("corrected_tag")), lambda t: t.isNotNull())
    species = abbreviate(config.species) if config.abbreviate_names else config.species
    full = simple_name(species, F.col("intron_id")) if config.simple_names else intron_name(species, F.col("gene"), F.col("transcript"), F.col("idx"), F.col("family_size"), F.col("omitted"), tags)
    return introns.withColumns({"tags": tags, "name": F.coalesce("given_name", full)})


def scorable(introns: DataFrame) -> DataFrame:
    """Neither left out nor a duplicate. P9."""
    return introns.where("omitted is null and duplicate is null")


def load_matrices(spark: SparkSession, path: str, config: Config) -> DataFrame:
    """Matrices with pseudocounts, custom files laid over, and gcag branch points taken from gtag ones. S9, S10, F15, A11."""
    base = pwm_files.read(spark, path)
    if config.pwms:
        custom = None
        for p in config.pwms:
            layer = pwm_files.read(spark, p)
            custom = layer if custom is None else relational.upsert(custom, layer, keys=[*KEY, "pos", "base"])
        base = pwm_files.overlay(base, custom)
    bp = base.where("subtype = 'u2' and dnts = 'gtag' and region = 'bp'").withColumns({"dnts": F.lit("gcag")})
    missing = bp.join(base.where("subtype = 'u2' and dnts = 'gcag' and region = 'bp'").select("subtype").distinct(), "subtype", "left_anti")
    return matrices.add_pseudocount(base.unionByName(missing.select(*base.columns)), config.pseudocount)


def from_sequences(spark: SparkSession, path: str, config: Config, label: str | None = None) -> DataFrame:
    """Usable introns of a sequence file. Entry B, S7, S8."""
    rows = sequences.assign(intron_files.read(spark, path, label), config).withColumns({"length": F.length("seq")})
    return rows.where(tagging.omission(config.least_length(12), 12, config.regions, True, True, False).isNull())


@dataclass(frozen=True)
class Fitted:
    """Means and deviations of the reference set's raw scores, and the models trained on it."""

    scale: dict[str, tuple[float, float]]
    models: list[svm.Model]


def fit_model(spark: SparkSession, references: DataFrame, pwms: DataFrame, config: Config) -> Fitted:
    """Raw scores of the references, their scale, and models. A17, M1-M3."""
    parts = [f"{r}_z" for r in config.regions]
    ref = references.select("intron_id", "type_id", "five_seq", "bp_region_seq", "three_seq", "dnts")
    raw_ref = scoring.score(ref, pwms, config).join(ref.select("intron_id", "type_id"), "intron_id").persist()
    stats = raw_ref.agg(*[F.avg(f"{r}_raw").alias(f"{r}_m") for r in config.regions], *[F.stddev_pop(f"{r}_raw").alias(f"{r}_s") for r in config.regions]).first()
    scale = {r: (stats[f"{r}_m"], stats[f"{r}_s"] or 1.0) for r in config.regions}
    models = svm.train(spark, raw_ref.withColumns(_z(scale)), parts, config.subsamples, config.hyper_c, config.optimise_rounds)
    raw_ref.unpersist()
    return Fitted(scale, models)


def _z(scale: dict[str, tuple[float, float]]) -> dict:
    return {f"{r}_z": (F.col(f"{r}_raw") - F.lit(m)) / F.lit(s) for r, (m, s) in scale.items()}


def apply_model(introns: DataFrame, pwms: DataFrame, fitted: Fitted, config: Config) -> DataFrame:
    """Raw scores, z-scores on the references' scale, prediction. M4, M5."""
    return svm.predict(scoring.score(introns, pwms, config).withColumns(_z(fitted.scale)), fitted.models, [f"{r}_z" for r in config.regions], config.threshold)


def classify(spark: SparkSession, introns: DataFrame, references: DataFrame, pwms: DataFrame, config: Config) -> DataFrame:
    """Raw scores, z-scores on the reference set, model, prediction. M6. Introns that can't be scored are left out."""
    if "omitted" in introns.columns:
        introns = scorable(introns)
    return apply_model(introns, pwms, fit_model(spark, references, pwms, config), config)


def build_matrices(spark: SparkSession, path: str, subtype: str, five: tuple[int, int] = (-20, 20), three: tuple[int, int] = (-20, 20), any_bounds: bool = False) -> DataFrame:
    """Matrices (subtype, dnts, region, pos, base, freq) of a sequence file's introns. Entry C, A6, A7, P6."""
    rows = intron_files.read_for_builder(spark, path)
    pair = F.concat(F.substring("seq", 1, 2), F.lit("-"), F.substring("seq", -2, 2))
    rows = rows.withColumns({"pair": pair})
    if not any_bounds:
        rows = rows.where(is_canonical(F.col("pair")) if subtype == "u12" else F.col("pair").isin("GT-AG", "GC-AG"))
    whole, up, down = F.concat("five", "seq", "three"), F.length("five"), F.length("three")
    cut = lambda at, coords: F.substring(whole, at + coords[0] + 1, F.lit(coords[1] - coords[0]))
    sites = F.array(F.struct(F.lit("five").alias("region"), cut(up, five).alias("s")), F.struct(F.lit("three").alias("region"), cut(F.length(whole) - down, three).alias("s")))
    width = F.when(F.col("region") == "five", five[1] - five[0]).otherwise(three[1] - three[0])
    sites = rows.select(F.lit(subtype).alias("subtype"), F.lower(F.replace("pair", F.lit("-"), F.lit(""))).alias("dnts"), F.inline(sites)).where(F.col("s").rlike("^[ACGTN]+$") & (F.length("s") == width))
    m = matrices.letter_matrix(sites, ["subtype", "dnts", "region"], "s")
    return m.withColumns({"pos": F.col("pos") + F.when(F.col("region") == "five", five[0]).otherwise(three[0])})
