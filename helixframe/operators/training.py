"""Matrices learnt from scored introns, demotion of doubtful calls, and a second round of training. A8-A11, M7, M8, P10, P11, F17, F22."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.config import Config
from helixframe.operators import matrices, relational, scoring, svm

#: (type, terminal pair, what the displayed 5' site begins with) of the empirical matrices (fixed values).
CLASSES = (("u12", "atac", "^AT[ACT]{3}"), ("u12", "gtag", "^GT[ACT]{3}"), ("u2", "gtag", "^GT"), ("u2", "gcag", "^GC"))


def empirical(introns: DataFrame, config: Config, min_seqs: int = 5, regions: tuple[str, ...] = ("five", "bp")) -> DataFrame:
    """Matrices (subtype, dnts, region, version, pos, base, freq) of scored introns, of classes with more than min_seqs. A8."""
    pair = F.lower(F.replace("dnts", F.lit("-"), F.lit("")))
    member = [F.when((pair == d) & F.col("five_display").rlike(p) & ((F.col("svm_score") > config.threshold) if t == "u12" else (F.col("type_id") == "u2")), F.struct(F.lit(t).alias("subtype"), F.lit(d).alias("dnts"))) for t, d, p in CLASSES]
    of_class = introns.withColumns({"__c": F.filter(F.array(*member), lambda c: c.isNotNull())}).withColumns({"__c": F.explode("__c")})
    seqs = {"five": F.col("five_seq"), "bp": F.col("bp_seq"), "three": F.col("three_seq")}
    parts = F.array(*[F.struct(F.lit(r).alias("region"), seqs[r].alias("s")) for r in regions])
    rows = of_class.select("__c.subtype", "__c.dnts", F.inline(parts)).where("s is not null and s <> ''")
    key = ["subtype", "dnts", "region"]
    enough = rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > min_seqs).select(*key)
    m = matrices.letter_matrix(rows.join(enough, key), key, "s")
    start = F.when(F.col("region") == "five", config.five_coords[0]).when(F.col("region") == "three", config.three_coords[0]).otherwise(0)
    return m.select(*key, F.lit(None).cast("string").alias("version"), (F.col("pos") + start).cast("int").alias("pos"), "base", "freq")


def branch_points(introns: DataFrame, pwms: DataFrame, config: Config, share: float = 0.95, min_count: int = 100) -> DataFrame | None:
    """The major-type branch-point matrix from data: of introns whose minor-type 5' score is below the percentile, the
    windows that the minor-type matrix likes best. None if too few remain. A9, A10, A11."""
    known = scoring.tables(pwms)
    fives = [(f, first) for (t, _), r in known.items() if t == "u12" for _, f, first in r.get("five", [])]
    bps = [f for (t, d), r in known.items() if t == "u12" and d == "gtag" for _, f, _ in r.get("bp", [])]

    def run(frames):
        import numpy as np

        for rows in frames:
            if not len(rows):
                continue
            codes = scoring._codes(rows["five_seq"])
            five = np.nanmax([scoring.place_scores(codes, f, first, config.five_coords[0], config.missing) for f, first in fives], axis=0)
            bp, best, seq = scoring._codes(rows["bp_region_seq"]), np.full(len(rows), -1.0), [None] * len(rows)
            for f in bps:
                s, at = scoring.window_scores(bp, f, config.missing)
                for i in np.flatnonzero((at >= 0) & (np.nan_to_num(s, nan=-1.0) >= best)):
                    best[i], seq[i] = s[i], rows["bp_region_seq"].iloc[i][at[i] : at[i] + len(f)]
            yield rows.assign(five_score=five, s=seq)[["five_score", "s", "dnts"]]

    found = introns.select("five_seq", "bp_region_seq", "dnts").mapInPandas(run, "five_score double, s string, dnts string").persist()
    cut = relational.quantiles(found, [], "five_score", [share]).first()["q"][0]
    rows = found.where((F.col("five_score") < F.lit(cut)) & F.col("dnts").isin("GT-AG", "GC-AG") & F.col("s").isNotNull())
    if rows.count() < min_count:
        return None
    keyed = rows.select(F.lit("u2").alias("subtype"), F.lit("gtag").alias("dnts"), F.lit("bp").alias("region"), "s")
    m = matrices.letter_matrix(keyed, ["subtype", "dnts", "region"], "s")
    return m.select("subtype", "dnts", "region", F.lit(None).cast("string").alias("version"), "pos", "base", "freq")


def swap_candidates(introns: DataFrame) -> DataFrame:
    """AT-AC introns whose 5' site doesn't begin ATATC, and noncanonical ones. P11."""
    return introns.where(((F.col("dnts") == "AT-AC") & ~F.col("five_display").startswith("ATATC")) | F.col("noncanonical"))


def mutate(introns: DataFrame, config: Config) -> DataFrame:
    """The same introns with GT and AG at their ends. F17."""
    five, three = -config.five_coords[0] + 1, -config.three_coords[0] - 1
    return introns.withColumns({"five_seq": F.overlay("five_seq", F.lit("GT"), F.lit(five)), "three_seq": F.overlay("three_seq", F.lit("AG"), F.lit(three)), "dnts": F.lit("GT-AG")})


def demote(scored: DataFrame, rescored: DataFrame, threshold: float) -> DataFrame:
    """Introns above the threshold that fall to it with canonical ends take the new scores and the tag [d]. M7, J10."""
    cols = ["svm_score", "score_distance", "label_ratio", "relative_score", "type_id", "five_raw", "bp_raw", "three_raw"]
    new = rescored.select("intron_id", *[F.col(c).alias(f"new_{c}") for c in cols])
    met = scored.join(new, "intron_id", "left")
    falls = F.coalesce((F.col("svm_score") > threshold) & (F.col("new_svm_score") <= threshold), F.lit(False))
    met = met.withColumns({"demoted": falls})
    out = met.withColumns({c: F.when(F.col("demoted"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in cols})
    return out.withColumns({"demoted_tag": F.when(F.col("demoted"), "[d]")}).drop(*[f"new_{c}" for c in cols])


def seeded_sample(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows by a hash of their id: the same in every run. O6."""
    return rows.orderBy(F.xxhash64("intron_id", F.lit(seed))).limit(n)


#: Minor-type introns that a second round trains on: far more than a genome has, and what the solver's driver can hold.
U12_LIMIT = 200_000


def confident(scored: DataFrame, references: DataFrame, u2_limit: int = 5000, u12_least: int = 50) -> DataFrame:
    """Training introns of a second round: scores above 90 or below 10, topped up from the first round's references. P10, U1."""
    u12 = seeded_sample(scored.where("svm_score > 90").withColumns({"type_id": F.lit("u12")}), U12_LIMIT)
    u2 = seeded_sample(scored.where("svm_score < 10 and type_id = 'u2'"), u2_limit)
    out = u12.unionByName(u2)
    for kind, got, want in (("u12", u12, u12_least), ("u2", u2, u2_limit)):
        if (short := want - got.limit(want).count()) > 0:
            out = out.unionByName(seeded_sample(references.where(F.col("type_id") == kind), short).select(*out.columns))
    return out


def recursive(spark: SparkSession, introns: DataFrame, scored: DataFrame, references: DataFrame, pwms: DataFrame, config: Config) -> DataFrame:
    """A second round with matrices and references learnt from the first: replaced from 100 minor introns on, averaged
    below, median-scaled; unchanged with five or fewer. M8, A18.

    introns and references: sequence columns with intron_id (distinct between the two); references with type_id too.
    """
    columns = ["intron_id", "five_seq", "bp_region_seq", "three_seq", "dnts", "five_display"]
    all_ = introns.select(*columns).join(scored.select("intron_id", "svm_score", "type_id", "bp_seq"), "intron_id")
    minor = scored.where(F.col("svm_score") > config.threshold).count()
    if minor <= 5:
        return scored
    learnt = matrices.add_pseudocount(empirical(all_, config, 10), config.pseudocount)
    key = ["subtype", "dnts", "region"]
    same = learnt.select(*key).distinct()
    if minor >= 100:
        new = pwms.join(same, key, "left_anti").unionByName(learnt)
    else:
        plain = pwms.withColumns({"version": F.coalesce("version", F.lit(""))})
        new = matrices.average(plain, learnt.select(*key, "pos", "base", "freq"), key).withColumns({"version": F.lit(None).cast("string")}) if plain.where("version <> ''").isEmpty() else pwms.join(same, key, "left_anti").unionByName(learnt)
    train = confident(all_.drop("bp_seq"), references.withColumns({"svm_score": F.lit(None).cast("double")}).select(*columns, "svm_score", "type_id"), config.recursive or 5000)
    raw_train = scoring.score(train, new, config).join(train.select("intron_id", "type_id"), "intron_id")
    parts = [f"{r}_z" for r in config.regions]
    fit = raw_train.agg(*[F.expr(f"percentile({r}_raw, array(0.25D, 0.5D, 0.75D))").alias(r) for r in config.regions]).first()
    z = {f"{r}_z": (F.col(f"{r}_raw") - fit[r][1]) / ((fit[r][2] - fit[r][0]) or 1.0) for r in config.regions}
    models = svm.train(spark, raw_train.withColumns(z), parts, config.subsamples, config.hyper_c, config.optimise_rounds)
    return svm.predict(scoring.score(introns, new, config).withColumns(z), models, parts, config.threshold)


def position_marks(seq: Column, cells: Column, most: Column, least: Column, start: int, missing: float = 1e-4) -> Column:
    """One character a place: * for the matrix's best base there, / for its worst, else tenths of the best. F22, K12.

    most, least: arrays of the largest and least frequency by place, from the matrix's first place on.
    """
    def mark(i: Column) -> Column:
        value = F.coalesce(F.element_at(cells, F.concat_ws("|", (i + start).cast("string"), F.substring(seq, i + 1, F.lit(1)))), F.lit(missing))
        top, low = F.get(most, i), F.get(least, i)
        return F.when(value >= top, "*").when(value <= low, "/").otherwise(F.floor(value / top * 10).cast("string"))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.length(seq) - 1, F.lit(0))), mark), "")


