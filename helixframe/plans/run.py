"""A whole run: sources to reports, and its command line. S7, S8, S11, S13, S14, M6, A17, A20, K2-K13, K16.

    python -m helixframe.plans.run -n homo_sapiens -g genome.fa -a genes.gff3 --matrices m.iic --r12 u12.iic --r2 u2.iic -o out

Reports are folders of text under the output folder, named like the species. Only counts, models and matrices reach the
driver; every report is one plan.
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.config import Config
from helixframe.functions.report import abbreviate
from helixframe.operators import training
from helixframe.plans import pipeline, sinks
from helixframe.sources import pwm as pwm_files

LOG = logging.getLogger("helixframe")

#: Columns that reports and tags need, with their types: sources without annotation have nulls there.
COLUMNS = {
    "region": "string", "strand": "string", "start": "int", "stop": "int", "transcript": "string", "gene": "string", "idx": "int", "family_size": "int",
    "fractional_position": "double", "phase": "tinyint", "defined_by": "string", "omitted": "string", "duplicate": "bigint", "overlap": "bigint", "longest_isoform": "boolean",
}


@dataclass
class Run:
    """What a run found: introns with scores (and null scores where they weren't scored), and its counts."""

    introns: DataFrame
    counts: dict[str, int]
    quality: list[float]


def source(spark: SparkSession, config: Config) -> DataFrame:
    """Introns of whichever source the options name, with all of COLUMNS. S11. Raises if there are none. S8."""
    found = pipeline.from_sequences(spark, config.sequences, config) if config.sequences else pipeline.extract(spark, config)
    found = found.withColumns({c: F.lit(None).cast(t) for c, t in COLUMNS.items() if c not in found.columns})
    found = found.persist()
    if found.isEmpty():
        raise ValueError("the source holds no introns")
    return found


def references(spark: SparkSession, config: Config) -> DataFrame:
    """The training introns of both types; numbers follow one another. Logs how many can't be used. S7."""
    out = None
    for at, (kind, path) in enumerate((("u12", config.reference_u12), ("u2", config.reference_u2))):
        if not path:
            raise ValueError(f"give a file of {kind} reference introns")
        rows = pipeline.from_sequences(spark, path, config, kind).withColumns({"intron_id": F.col("intron_id") + (at << 40)})
        dropped = pipeline.intron_files.read(spark, path, kind).count() - rows.count()
        LOG.info("%d %s reference introns can't be used", dropped, kind)
        out = rows if out is None else out.unionByName(rows)
    return out


def with_branch_points(spark: SparkSession, introns: DataFrame, pwms: DataFrame, config: Config) -> DataFrame:
    """The major type's branch-point matrices. A11: the conserved file's replace what is there, if one is named; those
    learnt from the introns fill in only where there is none, and fall back to the conserved ones."""
    site = (F.col("subtype") == "u2") & (F.col("region") == "bp")
    known = not pwms.where(site & (F.col("dnts") == "gtag")).isEmpty()
    learnt = training.branch_points(introns, pwms, config) if config.generate_u2_bps_pwm and not known else None
    if learnt is None and config.conserved_u2_bp and not (config.generate_u2_bps_pwm and known):
        learnt = pwm_files.read(spark, config.conserved_u2_bp).where(site & (F.col("dnts") == "gtag"))
    if learnt is None:
        return pwms
    learnt = learnt.withColumns({"freq": F.col("freq") + F.lit(config.pseudocount)})
    both = learnt.unionByName(learnt.withColumns({"dnts": F.lit("gcag")})).select(*pwms.columns)
    return pwms.where(~(site & F.col("dnts").isin("gtag", "gcag"))).unionByName(both)


def demoted(introns: DataFrame, scored: DataFrame, pwms: DataFrame, model: pipeline.Fitted, config: Config) -> DataFrame:
    """Scores after demotion, with the old ones of what fell: only where terminal pairs count in the score. M7."""
    doubtful = training.mutate(training.swap_candidates(introns), config)
    again = pipeline.apply_model(doubtful, pwms, model, config)
    was = scored.select("intron_id", F.struct("svm_score", *[f"{r}_z" for r in config.regions]).alias("was"))
    out = training.demote(scored, again, config.threshold)
    now = again.select("intron_id", *[F.col(f"{r}_z").alias(f"__{r}") for r in config.regions])
    out = out.join(was, "intron_id", "left").join(now, "intron_id", "left")
    return out.withColumns({f"{r}_z": F.when(F.col("demoted"), F.col(f"__{r}")).otherwise(F.col(f"{r}_z")) for r in config.regions}).drop(*[f"__{r}" for r in config.regions])


def rescaled(scored: DataFrame, regions: Sequence[str]) -> DataFrame:
    """Z-scores for the reports: scaled anew on all scored introns. A17."""
    fit = scored.agg(*[F.avg(f"{r}_raw").alias(f"{r}_m") for r in regions], *[F.stddev_pop(f"{r}_raw").alias(f"{r}_s") for r in regions]).first()
    return scored.withColumns({f"{r}_z": (F.col(f"{r}_raw") - F.lit(fit[f"{r}_m"])) / F.lit(fit[f"{r}_s"] or 1.0) for r in regions})


def class_counts(introns: DataFrame, threshold: float) -> dict[str, int]:
    """A20, A24: minor-type introns above the threshold, those with AT-AC ends, and the classes of the scatter plot."""
    above = F.col("svm_score") > threshold
    spread = introns.agg(F.stddev_pop("svm_score")).first()[0] or 0.0
    near = (F.col("svm_score") > threshold - spread) & ~above
    return introns.agg(F.count_if(above).alias("u12"), F.count_if(above & (F.col("dnts") == "AT-AC")).alias("atac"), F.count_if(near).alias("near"), F.count_if(~above & ~near).alias("below")).first().asDict()


def score(spark: SparkSession, found: DataFrame, pwms: DataFrame, config: Config) -> Run:
    """Scores the introns that can be scored, demotes, and learns a second round if that is asked for. M6, M8."""
    usable = pipeline.scorable(found).persist()
    refs = references(spark, config).persist()
    pwms = with_branch_points(spark, usable, pwms, config).persist()
    model = pipeline.fit_model(spark, refs, pwms, config)
    scored = pipeline.apply_model(usable, pwms, model, config).persist()
    if config.recursive is not None:
        first = scored
        scored = training.recursive(spark, usable, first, refs, pwms, config).persist()
    joined = usable.select("intron_id", "five_seq", "three_seq", "bp_region_seq", "five_display", "dnts", "noncanonical")
    if not config.ignore_ambiguous_ends:
        scored = demoted(joined, scored, pwms, model, config)
    else:
        none = F.lit(None)
        scored = scored.withColumns({"demoted": F.lit(False), "demoted_tag": none.cast("string"), "was": none})
    scored = rescaled(scored, config.regions).withColumns({f"{r}_z": F.lit(None).cast("double") for r in ("five", "bp", "three") if r not in config.regions})
    out = found.drop("type_id").join(scored, "intron_id", "left").persist()
    return Run(out, class_counts(out.where("svm_score is not null"), config.threshold), [m.quality for m in model.models])


def write_reports(run: Run, pwms: DataFrame, config: Config, folder: str) -> list[str]:
    """Writes what the options ask for; names of the reports."""
    name = abbreviate(config.species) if config.abbreviate_filenames else config.species
    kept = run.introns.where("duplicate is null")
    shown = run.introns if config.include_duplicates else kept
    listed = shown if config.sequences_only else kept
    lines = {"meta": sinks.meta(listed)}
    if not config.sequences:
        lines["bed"] = sinks.bed(listed)
        lines["dupe_map"] = sinks.superseded(run.introns, "duplicate")
        if not config.allow_overlap:
            lines["overlap"] = sinks.superseded(run.introns, "overlap")
    if config.sequence_output:
        lines["introns"] = sinks.introns_file(shown)
    if not config.sequences_only:
        lines["score_info"] = sinks.score_info(kept)
        if not config.ignore_ambiguous_ends:
            lines["demoted"] = sinks.demoted(kept, config.regions)
        if config.pwm_score_info:
            lines["pwm_score_info"] = sinks.pwm_score_info(kept.where("svm_score is not null"), pwms, config)
        if config.subsamples:
            lines["classifier_performance"] = kept.sparkSession.createDataFrame([(f"{i}\t{q:.6f}",) for i, q in enumerate(run.quality)], "value string")
    for report, text in lines.items():
        sinks.write(text, f"{folder.rstrip('/')}/{name}.{report}.iic")
    return sorted(lines)


def run(spark: SparkSession, config: Config, folder: str) -> Run:
    """One run of the options, with its reports in folder."""
    found = source(spark, config)
    for row in sinks.omission_counts(found).collect():
        LOG.info("%d introns left out: %s", row["n"], row["omitted"])
    for row in sinks.noncanonical_counts(found).orderBy(F.desc("n")).limit(20).collect():
        LOG.info("noncanonical %s: %d", row["dnts"], row["n"])
    empty = {c: F.lit(None).cast("double") for c in ("svm_score", "relative_score", "score_distance")} | {c: F.lit(None).cast("string") for c in ("bp_seq", "bp_seq_u2")} | {"bp_start": F.lit(None).cast("int")}
    if config.sequences_only:
        out, pwms = Run(found.withColumns({k: v for k, v in empty.items() if k not in found.columns}), {}, []), None
    else:
        if not config.matrices:
            raise ValueError("give a file of matrices")
        pwms = pipeline.load_matrices(spark, config.matrices, config).persist()
        out = score(spark, found, pwms, config)
        LOG.info("classifier F1 on held-out references: %s", ", ".join(f"{q:.6f}" for q in out.quality))
        LOG.info("%d putative U12-type introns with scores > %s%%, %d of them AT-AC", out.counts["u12"], config.threshold, out.counts["atac"])
    LOG.info("wrote %s", ", ".join(write_reports(out, pwms, config, folder)))
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="helixframe", description="Finds, scores and classifies introns.")
    add = p.add_argument
    add("-n", "--species_name", dest="species", required=True)
    add("-g", "--genome")
    add("-a", "--annotation")
    add("-b", "--bed")
    add("-q", "--sequence_file", dest="sequences")
    add("-o", "--output", default=".", help="folder of the reports")
    add("--matrices", help="file of the default matrices")
    add("--conserved_u2_bp", help="file with the conserved major-type branch-point matrix")
    add("-f", "--feature", dest="features", choices=("cds", "exon"), action="append")
    add("-s", "--sequences_only", action="store_true")
    add("--no_nc", dest="allow_noncanonical", action="store_false")
    add("-i", "--allow_multiple_isoforms", dest="longest_only", action="store_false")
    add("-v", "--no_intron_overlap", dest="allow_overlap", action="store_false")
    add("--pwms", nargs="+", default=())
    add("--generate_u2_bps_pwm", action="store_true")
    add("--reference_u12s", "--r12", dest="reference_u12")
    add("--reference_u2s", "--r2", dest="reference_u2")
    add("-d", "--include_duplicates", action="store_true")
    add("-u", "--uninformative_naming", dest="simple_names", action="store_true")
    add("--no_abbreviate", "--na", dest="abbreviate_names", action="store_false")
    add("--abbreviate_filenames", "--afn", action="store_true")
    add("-t", "--threshold", type=float, default=90.0)
    add("--no_sequence_output", "--ns", dest="sequence_output", action="store_false")
    for flags, dest, default in ((("--five_score_coords", "--5c"), "five_coords", (-3, 9)), (("--three_score_coords", "--3c"), "three_coords", (-6, 4)), (("--branch_point_coords", "--bpc"), "bp_coords", (-55, -5))):
        add(*flags, dest=dest, nargs=2, type=int, default=default)
    add("-r", "--scoring_regions", dest="regions", nargs="+", default=("five", "bp", "three"))
    add("--recursive", nargs="?", type=int, const=5000, default=None, help="a second round; the number bounds its major-type references")
    add("--n_subsample", dest="subsamples", type=int, default=0)
    add("--pwm_score_info", action="store_true")
    add("-C", "--hyperparameter_C", dest="hyper_c", type=float)
    add("--min_intron_len", dest="min_length", type=int, default=30)
    add("--pseudocount", type=float, default=1e-4)
    add("--exons_as_flanks", action="store_true")
    add("--no_ignore_nc_dnts", dest="ignore_ambiguous_ends", action="store_false")
    add("--no_nc_ss_adjustment", dest="adjust_splice_sites", action="store_false")
    return p


def config_of(arguments: Sequence[str] | None = None) -> tuple[Config, str]:
    """The options of a command line, checked, and the output folder. S13."""
    given = vars(parser().parse_args(arguments))
    folder = given.pop("output")
    given["features"] = tuple(given["features"] or ("cds", "exon"))
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}), folder


def main(arguments: Sequence[str] | None = None) -> None:
    config, folder = config_of(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    spark = SparkSession.builder.appName("helixframe").getOrCreate()
    run(spark, config, folder)


if __name__ == "__main__":
    main()
