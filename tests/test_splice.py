import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.config import Config
from helixframe.functions import dna, report
from helixframe.operators import introns as intron_ops
from helixframe.operators import matrices, relational, scoring, sequences, svm
from helixframe.plans import pipeline, sinks
from helixframe.sources import bed, fasta, gff, lines, pwm
from helixframe.sources import introns as intron_files
from tests import fixtures


def test_config_refuses_what_the_reference_refuses():
    for bad in ({}, {"genome": "g"}, {"sequences": "s", "genome": "g"}, {"genome": "g", "bed": "b", "exons_as_flanks": True}, {"sequences": "s", "threshold": 101}, {"sequences": "s", "regions": ("x",)}):
        with pytest.raises(ValueError):
            Config(**bad)
    assert Config(sequences="s").least_length(12) == 30


def test_slices_follow_python(spark):
    rng, rows = random.Random(0), []
    for i in range(300):
        rows.append((i, "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 9))), rng.randint(-12, 12), rng.randint(-12, 12)))
    df = spark.createDataFrame(rows, "i int, s string, a int, b int").select("i", dna.py_slice(F.col("s"), F.col("a"), F.col("b")).alias("x"), dna.py_slice(F.col("s"), F.col("a"), None).alias("y"))
    assert {r.i: (r.x, r.y) for r in df.collect()} == {i: (s[a:b], s[a:]) for i, s, a, b in rows}


def test_scalar_functions(spark):
    df = spark.createDataFrame([("ACGTN", "GA-AG", 146), ("", "AT-AA", 0)], "s string, p string, n int")
    out = df.select(dna.reverse_complement(dna.reverse_complement(F.col("s"))).alias("same"), dna.reverse_complement(F.col("s")).alias("rc"), dna.ambiguous_pair(F.col("p")).alias("tie"), F.size(dna.kmers(F.col("s"), 2)).alias("k")).collect()
    assert [(r.same, r.rc, r.tie, r.k) for r in out] == [("ACGTN", "NACGT", True, 4), ("", "", False, 0)]
    lo, hi = dna.relative_coords(F.lit(101), F.lit(200), F.lit("+"), "three", -54, -5)
    mlo, mhi = dna.relative_coords(F.lit(101), F.lit(200), F.lit("-"), "three", -54, -5)
    assert tuple(spark.range(1).select(lo, hi, mlo, mhi).first()) == (146, 195, 106, 155)
    assert report.abbreviate("homo_sapiens") == "HomSap"


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    (tmp_path / "x.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    got = lines.numbered_lines(spark, str(tmp_path / "x.txt")).collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.line_number: r.value for r in got} == {i: f"line {i}" for i in range(5000)}


def test_fasta_chunks_give_any_slice(spark, tmp_path):
    path, _ = fixtures.write_genome(tmp_path)
    genome = fixtures.genome()
    contigs = fasta.read(spark, path)
    assert {r.region: (r.seq, r.region_order) for r in contigs.collect()} == {c: (s, i + 1) for i, (c, s) in enumerate(genome.items())}
    rng = random.Random(2)
    wanted = [(i, rng.choice(list(genome)), a := rng.randint(-50, 6000), a + rng.randint(0, 700)) for i in range(100)]
    got = fasta.slices(spark.createDataFrame(wanted, "id long, region string, lo int, hi int"), fasta.chunks(contigs, 97), 97)
    assert {r.id: r.seq for r in got.collect() if r.seq} == {i: x for i, c, a, b in wanted if (x := genome[c][max(a, 1) - 1 : max(b, 0)])}


def test_introns_of_a_hand_made_annotation(spark, tmp_path):
    _, path = fixtures.write_genome(tmp_path)
    rows = gff.read(spark, path)
    assert gff.usable_features(rows, ("cds", "exon")) == ("cds", "exon")
    found = intron_ops.derive(gff.normalise(rows)).collect()
    got = {(r.transcript, r.defined_by, r.start, r.stop, r.idx, r.family_size, r.phase) for r in found}
    # the overlapping pair 2201-2300, 2250-2400 leaves no intron; t1's last intron is defined by exons alone
    assert got == {("t1", "cds", 201, 300, 1, 3, 2), ("t1", "cds", 401, 600, 2, 3, 2), ("t1", "exon", 701, 1200, 3, 3, None), ("t2", "exon", 201, 600, 1, 1, None), ("t3", "exon", 2401, 2900, 1, 2, None), ("t3", "exon", 2101, 2200, 2, 2, None)}
    assert {r.transcript: (r.gene, r.parent_length) for r in found} == {"t1": ("g1", 200), "t2": ("g1", 200), "t3": ("g2", 451)}
    assert {(r.idx, r.fractional_position) for r in found if r.transcript == "t1"} == {(1, 14.286), (2, 42.857), (3, 71.429)}


def test_extraction_end_to_end(spark, tmp_path):
    path, annotation = fixtures.write_genome(tmp_path)
    config = Config(species="homo_sapiens", genome=path, annotation=annotation, longest_only=False, adjust_splice_sites=False, chunk=500)
    out = pipeline.extract(spark, config).persist()
    genome = fixtures.genome()
    for r in out.collect():
        seq = genome[r.region][r.start - 1 : r.stop]
        up, down = genome[r.region][max(0, r.start - 201) : r.start - 1], genome[r.region][r.stop : r.stop + 200]
        if r.strand == "-":
            seq, up, down = fixtures.rc(seq), fixtures.rc(down), fixtures.rc(up)
        assert (r.seq, r.upstream_flank, r.downstream_flank) == (seq, up, down)
        whole = up + seq + down
        assert r.five_seq == whole[len(up) - 3 : len(up) + 9] and r.three_seq == whole[len(whole) - len(down) - 6 : len(whole) - len(down) + 4]
        assert r.bp_region_seq == (seq[9:-5] if len(seq) < 63 else seq[len(seq) - 55 : -5])
        assert r.dnts == f"{seq[:2]}-{seq[-2:]}"
        assert r.name.startswith("HomSap-g")
    assert sinks.superseded(out, "duplicate").count() == out.where("duplicate is not null").count()
    assert {r.transcript for r in out.where("longest_isoform").collect()} == {"t1", "t3"}
    out.unpersist()


def test_bed_rows(spark, tmp_path):
    (tmp_path / "x.bed").write_text("#c\nchr1\t100\t200\ta\t0\t+\nchr1\t300\t250\t.\t0\t-\nchr1\tx\t9\tb\t0\t+\nchr1\t1\t2\tb\t0\t.\nshort\t1\n")
    assert {(r.region, r.start, r.stop, r.name, r.strand) for r in bed.read(spark, str(tmp_path / "x.bed")).collect()} == {("chr1", 101, 200, "a", "+"), ("chr1", 251, 300, "i_3", "-")}


def test_sequence_files_and_builder(spark, tmp_path):
    (tmp_path / "i.iic").write_text("#x\nn1\t9.5\tacg\tGTAAAG\tTT\n.\tAC\tGTCCAG\tGGG\n.\t.\tAC\tGTCCAG\tGGG\n")
    got = {r.name: (r.upstream_flank, r.seq, r.downstream_flank, r.flank) for r in intron_files.read(spark, str(tmp_path / "i.iic")).collect()}
    assert got == {"n1": ("ACG", "GTAAAG", "TT", 3), "auto_intron_1": ("AC", "GTCCAG", "GGG", 3), "auto_intron_2": ("AC", "GTCCAG", "GGG", 3)}
    (tmp_path / "b.iic").write_text(fixtures.training("u2", 40, 5))
    m = pipeline.build_matrices(spark, str(tmp_path / "b.iic"), "u2", (-3, 9), (-6, 4)).toPandas()
    assert set(m.region) == {"five", "three"} and np.allclose(m.groupby(["region", "pos"]).freq.sum(), 1)
    assert m[(m.region == "five") & (m.pos == 0) & (m.base == "G")].freq.item() == 1 and set(m[m.region == "three"].pos) == set(range(-6, 4))


def test_matrix_files(spark, tmp_path):
    (tmp_path / "m").write_text(fixtures.matrix_lines())
    got = pwm.read(spark, str(tmp_path / "m"))
    want = {(*k, start + i, b): f for k, rows in fixtures.parse(fixtures.matrix_lines()).items() for start in [{"five": -3, "bp": 0, "three": -6}[k[2]]] for i, r in enumerate(rows) for b, f in r.items()}
    assert {(r.subtype, r.dnts, r.region, r.pos, r.base): r.freq for r in got.collect()} == want
    (tmp_path / "c").write_text(">u12_gtag_bp-vA10\nA\tC\tG\tT\n1\t0\t0\t0\n")
    over = pwm.overlay(got, pwm.read(spark, str(tmp_path / "c")))
    assert {(r.version, r.pos) for r in over.where("subtype = 'u12' and dnts = 'gtag' and region = 'bp'").collect()} == {("A10", 0)}


def naive(seq, rows):
    p = 1.0
    for c, r in zip(seq, rows, strict=False):
        p *= r.get(c, 1e-4)
    return p


def test_scores_match_a_naive_product(spark, tmp_path):
    (tmp_path / "m").write_text(fixtures.matrix_lines())
    (tmp_path / "s").write_text(fixtures.training("u12", 25, 9) + fixtures.training("u2", 25, 8))
    config = Config(sequences=str(tmp_path / "s"))
    pwms = pipeline.load_matrices(spark, str(tmp_path / "m"), config)
    introns = pipeline.from_sequences(spark, str(tmp_path / "s"), config)
    got = {r.intron_id: r for r in scoring.score(introns, pwms, config).collect()}
    m = {k: [{b: f + 1e-4 for b, f in r.items()} for r in rows] for k, rows in fixtures.parse(fixtures.matrix_lines()).items()}
    for r in introns.collect():
        def bp(subtype):
            return max(naive(r.bp_region_seq[i : i + 12], m[subtype, "gtag", "bp"]) for i in range(len(r.bp_region_seq) - 11))
        assert math.isclose(got[r.intron_id].five_raw, math.log2(naive(r.five_seq, m["u12", "gtag", "five"]) / naive(r.five_seq, m["u2", "gtag", "five"])), rel_tol=1e-9)
        assert math.isclose(got[r.intron_id].bp_raw, math.log2(bp("u12") / bp("u2")), rel_tol=1e-9)
        assert naive(got[r.intron_id].bp_seq, m["u12", "gtag", "bp"]) == pytest.approx(bp("u12"))
    cells = matrices.as_map(pwms.where("subtype = 'u12' and dnts = 'gtag' and region = 'bp'"), ["subtype"])
    sql = introns.crossJoin(cells).select("intron_id", matrices.best_window(F.col("bp_region_seq"), F.col("cells"), 12).alias("b")).collect()
    assert all(r.b.seq == got[r.intron_id].bp_seq and r.b.start == got[r.intron_id].bp_start for r in sql)


def test_classifier_tells_planted_types(spark, tmp_path):
    (tmp_path / "m").write_text(fixtures.matrix_lines())
    (tmp_path / "ref").write_text(fixtures.training("u12", 60, 1))
    (tmp_path / "ref2").write_text(fixtures.training("u2", 200, 2))
    (tmp_path / "q").write_text(fixtures.training("u12", 20, 3) + fixtures.training("u2", 60, 4))
    config = Config(sequences=str(tmp_path / "q"), hyper_c=1.0)
    pwms = pipeline.load_matrices(spark, str(tmp_path / "m"), config)
    ref = pipeline.from_sequences(spark, str(tmp_path / "ref"), config, "u12").unionByName(pipeline.from_sequences(spark, str(tmp_path / "ref2"), config, "u2").withColumns({"intron_id": F.col("intron_id") + 1000}))
    query = pipeline.from_sequences(spark, str(tmp_path / "q"), config).persist()
    out = pipeline.classify(spark, query, ref, pwms, config).join(query.select("intron_id", "name"), "intron_id").toPandas()
    assert (out.type_id == out.name.str.split("_").str[0]).mean() > 0.95
    assert out[out.type_id == "u12"].svm_score.min() > out[out.type_id == "u2"].svm_score.max() - 40


def test_solver_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(1, 1, (60, 2)), rng.normal(-1, 1, (90, 2))])
    y = np.r_[np.ones(60), -np.ones(90)]
    w, b = svm.solve(x, y, 0.5, np.ones(150), 1e-6)
    loss = lambda v, a: 0.5 * v @ v + 0.5 * np.maximum(0, 1 - y * (x @ v + a)).sum()
    best = loss(w, b)
    for _ in range(400):
        assert loss(w + rng.normal(0, 0.05, 2), b + rng.normal(0, 0.05)) >= best - 1e-4
    slope, shift = svm.platt(x @ w + b, y)
    assert slope < 0 and abs(shift) < 2


def test_grid_search_runs_on_the_cluster(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(1, 1, (20, 1)), rng.normal(-1, 1, (30, 1))])
    c = svm.search(spark, x, np.r_[np.ones(20), -np.ones(30)], rounds=2, divisions=4)
    assert 1e-6 <= c <= 1e6


def test_annotation_is_corrected(spark):
    rows = spark.createDataFrame([(1, "c\tx\tCDS\t1\t100\t.\t+\t0\tP=1"), (2, "c\tx\tCDS\t201\t300\t.\t+\t1\tP=1;"), (3, "other")], "line_number int, value string")
    moved = spark.createDataFrame([(-2, "+", (1,), (2,))], "shift int, strand string, upstream_exon struct<line_number:int>, downstream_exon struct<line_number:int>")
    out = {r.line_number: r.value for r in sequences.fixed_annotation(rows, sequences.annotation_fixes(moved)).collect()}
    assert out == {1: "c\tx\tCDS\t1\t98\t.\t+\t0\tP=1;shift:stop:-2", 2: "c\tx\tCDS\t199\t300\t.\t+\t0\tP=1;shift:start:-2", 3: "other"}


def test_second_round_demotion_and_learnt_matrices(spark, tmp_path):
    from helixframe.operators import training

    (tmp_path / "m").write_text(fixtures.matrix_lines())
    for name, kind, n, seed in (("r12", "u12", 40, 1), ("r2", "u2", 120, 2), ("q12", "u12", 30, 3), ("q2", "u2", 150, 4)):
        (tmp_path / name).write_text(fixtures.training(kind, n, seed))
    config = Config(sequences="q", hyper_c=1.0, threshold=50)
    pwms = pipeline.load_matrices(spark, str(tmp_path / "m"), config).persist()
    take = lambda name, label, at: pipeline.from_sequences(spark, str(tmp_path / name), config, label).withColumns({"intron_id": F.col("intron_id") + at})
    ref = take("r12", "u12", 1000).unionByName(take("r2", "u2", 2000)).persist()
    query = take("q12", None, 0).unionByName(take("q2", None, 500)).persist()
    scored = pipeline.classify(spark, query, ref, pwms, config).persist()
    learnt = training.empirical(scored.join(query.select("intron_id", "five_seq", "dnts", "five_display"), "intron_id"), config).toPandas()
    assert {("u2", "gtag", "five"), ("u2", "gtag", "bp")} <= set(map(tuple, learnt[["subtype", "dnts", "region"]].values))
    assert np.allclose(learnt.groupby(["subtype", "dnts", "region", "pos"]).freq.sum(), 1)
    bp = training.branch_points(query, pwms, config, min_count=10).toPandas()
    assert len(bp) >= 48 and np.allclose(bp.groupby("pos").freq.sum(), 1) and training.branch_points(query, pwms, config, min_count=10_000) is None
    again = training.recursive(spark, query, scored, ref, pwms, config).toPandas().set_index("intron_id")
    assert np.mean([(again.type_id[i] == "u12") == (i < 500) for i in again.index]) > 0.9
    mutant = training.mutate(training.swap_candidates(query.withColumns({"noncanonical": F.lit(True)})), config)
    assert {(r.five_seq[3:5], r.three_seq[4:6]) for r in mutant.collect()} == {("GT", "AG")}
    down = training.demote(scored, scored.withColumns({"svm_score": F.lit(1.0)}), 50)
    assert down.where("demoted").count() == scored.where("svm_score > 50").count() == down.where("demoted_tag = '[d]' and svm_score = 1").count()
    marks = spark.range(1).select(training.position_marks(F.lit("AC"), F.create_map(F.lit("0|A"), F.lit(0.5), F.lit("1|C"), F.lit(0.2)), F.array(F.lit(0.5), F.lit(0.7)), F.array(F.lit(0.1), F.lit(0.1)), 0).alias("m")).first().m
    assert marks == "*2"


def test_quantiles_and_curves_against_one_buffer(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), rng.choice([rng.gauss(0, 1e3), 1.0, 2.0, float(rng.randint(0, 4))]), rng.random() < 0.3) for _ in range(3000)]
    rows += [("one", 5.0, True), ("same", 1.5, False), ("same", 1.5, True), ("a", None, True), ("wide", float("-inf"), True), ("wide", 0.0, False), ("wide", 1e308, False)]
    df = spark.createDataFrame(rows, "k string, v double, t boolean")
    shares = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = {r.k: r.q for r in relational.quantiles(df, ["k"], "v", shares).collect()}
    assert got == {r.k: r.q for r in df.groupBy("k").agg(F.expr(f"percentile(v, array({', '.join(f'{s}D' for s in shares)}))").alias("q")).collect()}
    assert relational.quantiles(df.where("false"), [], "v", [0.5]).first().q == [None]
    curve = {r.v: (r.precision, r.recall) for r in relational.precision_recall(df, "t", "v").collect()}
    known = [(v, t) for _, v, t in rows if v is not None]
    for v in {v for v, _ in known}:
        above = [t for x, t in known if x >= v]
        assert curve[v] == (sum(above) / len(above), sum(above) / sum(t for _, t in known))
    assert not relational.precision_recall(df.where("false"), "t", "v").collect()
