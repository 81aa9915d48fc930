"""A whole run from files to reports, through the command line's options."""

import random

import pytest

from helixframe.plans import run as whole
from helixframe.sources import introns as intron_files
from tests import fixtures


def lines(folder, report):
    return [x.rstrip("\n") for p in sorted((folder / report).glob("part-*")) for x in p.read_text().splitlines()]


def planted(folder):
    """A genome whose genes hold introns of known type between exons of 60 bases, with annotation."""
    rng, rows, genome, truth = random.Random(7), ["##gff-version 3"], "", {}
    for kind, n, seed in (("u12", 25, 11), ("u2", 75, 12)):
        for k, line in enumerate(fixtures.training(kind, n, seed).splitlines()):
            _, _, up, intron, down = line.split("\t")
            body = lambda m: "".join(rng.choice("ACGT") for _ in range(m))
            genome += body(40)
            at = len(genome)
            genome += body(55) + up[-5:] + intron + down[:5] + body(55)
            gene, transcript = f"{kind}g{k}", f"{kind}t{k}"
            a, z = at + 60, at + 60 + len(intron)
            for t in (transcript, transcript + "b"):
                rows += [f"c1\tx\tmRNA\t{at + 1}\t{len(genome)}\t.\t+\t.\tID={t};Parent={gene}", f"c1\tx\texon\t{at + 1}\t{a}\t.\t+\t.\tParent={t}", f"c1\tx\texon\t{z + 1}\t{len(genome)}\t.\t+\t.\tParent={t}"]
            truth[gene] = (kind, intron)
    (folder / "g.fa").write_text(">c1 a->b\n" + genome + "\n")
    (folder / "a.gff3").write_text("\n".join(rows) + "\n")
    return truth


def test_a_run_writes_every_report(spark, tmp_path):
    truth = planted(tmp_path)
    (tmp_path / "m").write_text(fixtures.matrix_lines())
    (tmp_path / "r12").write_text(fixtures.training("u12", 60, 1))
    (tmp_path / "r2").write_text(fixtures.training("u2", 200, 2) + "short\t1\tA\tGTAG\tC\n")
    out = tmp_path / "out"
    command = f"-n homo_sapiens -g {tmp_path}/g.fa -a {tmp_path}/a.gff3 --matrices {tmp_path}/m --r12 {tmp_path}/r12 --r2 {tmp_path}/r2 -o {out} -C 1 -t 50 -i -v -d --pwm_score_info --no_ignore_nc_dnts --n_subsample 2 --no_nc_ss_adjustment"
    assert whole.config_of([*command.split(), "--recursive", "100"])[0].recursive == 100
    config, folder = whole.config_of(command.split())
    assert config.recursive is None and config.regions == ("five", "bp", "three") and folder == str(out)
    result = whole.run(spark, config, folder)
    meta = [x.split("\t") for x in lines(out, "homo_sapiens.meta.iic")]
    assert len(meta) == len(truth) and all(len(r) == 14 for r in meta)
    kind = {r[7]: r[12] for r in meta}
    assert sum(kind[g] == t for g, (t, _) in truth.items()) > 0.9 * len(truth)
    scores = [float(r[1]) for r in meta]
    assert scores == sorted(scores)
    seqs = [x.split("\t") for x in lines(out, "homo_sapiens.introns.iic")]
    assert sorted(r[3] for r in seqs) == sorted([i for _, i in truth.values()] * 2)
    assert len(lines(out, "homo_sapiens.dupe_map.iic")) == len(truth) == len(lines(out, "homo_sapiens.bed.iic")) == len(lines(out, "homo_sapiens.score_info.iic"))
    info = lines(out, "homo_sapiens.pwm_score_info.iic")
    assert len(info) == 4 * len(truth) and all(x.startswith(">HomSap-") for x in info[::4])
    for u12, seq, u2 in zip(info[1::4], info[2::4], info[3::4], strict=True):
        assert [len(x) for x in u12.split("\t")[:3]] == [len(x) for x in seq.split("\t")[:3]] == [len(x) for x in u2.split("\t")[:3]] == [12, 12, 10]
        assert u12.split("\t")[3].startswith("u12-") and u2.split("\t")[3].startswith("u2-")
    assert len(lines(out, "homo_sapiens.classifier_performance.iic")) == 2
    assert all(" --> " in x for x in lines(out, "homo_sapiens.demoted.iic"))
    assert result.counts["u12"] + result.counts["near"] + result.counts["below"] == len(truth) and 15 < result.counts["u12"] < 35


def test_sequences_alone_and_sources_without_introns(spark, tmp_path):
    (tmp_path / "q").write_text(fixtures.training("u2", 5, 3))
    config, folder = whole.config_of(f"-n x -q {tmp_path}/q -s -o {tmp_path}/o --ns".split())
    whole.run(spark, config, folder)
    assert len(lines(tmp_path / "o", "x.meta.iic")) == 5 and not (tmp_path / "o" / "x.introns.iic").exists()
    (tmp_path / "e").write_text("# nothing\n")
    with pytest.raises(ValueError, match="no introns"):
        whole.run(spark, *whole.config_of(f"-n x -q {tmp_path}/e -o {tmp_path}/o2".split()))
    assert intron_files.read(spark, str(tmp_path / "e")).isEmpty()
