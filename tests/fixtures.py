"""A small synthetic genome with hand-placed genes, and matrices and training introns from fixed seeds."""

import random

PAIR = {"gtag": ("GT", "AG"), "gcag": ("GC", "AG"), "atac": ("AT", "AC")}


def rc(s):
    return s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


def genome(seed=1, size=6000):
    rng = random.Random(seed)
    return {c: "".join(rng.choice("ACGT") for _ in range(size)) for c in ("chr2", "chr1")}


GFF = """##gff-version 3
chr1\tx\tgene\t101\t1300\t.\t+\t.\tID=g1
chr1\tx\tmRNA\t101\t1300\t.\t+\t.\tID=t1;Parent=g1
chr1\tx\texon\t101\t200\t.\t+\t.\tParent=t1
chr1\tx\tCDS\t151\t200\t.\t+\t0\tParent=t1
chr1\tx\texon\t301\t400\t.\t+\t.\tParent=t1
chr1\tx\tCDS\t301\t400\t.\t+\t2\tParent=t1
chr1\tx\texon\t601\t700\t.\t+\t.\tParent=t1
chr1\tx\tCDS\t601\t650\t.\t+\t1\tParent=t1
chr1\tx\texon\t1201\t1300\t.\t+\t.\tParent=t1
chr1\tx\tmRNA\t101\t700\t.\t+\t.\tID=t2;Parent=g1
chr1\tx\texon\t101\t200\t.\t+\t.\tParent=t2
chr1\tx\texon\t601\t700\t.\t+\t.\tParent=t2
chr2\tx\tgene\t2001\t3000\t.\t-\t.\tID=g2
chr2\tx\tmRNA\t2001\t3000\t.\t-\t.\tID=t3;Parent=g2
chr2\tx\texon\t2001\t2100\t.\t-\t.\tParent=t3
chr2\tx\texon\t2201\t2300\t.\t-\t.\tParent=t3
chr2\tx\texon\t2250\t2400\t.\t-\t.\tParent=t3
chr2\tx\texon\t2901\t3000\t.\t-\t.\tParent=t3
bad line
"""


def write_genome(folder):
    path = folder / "genome.fa"
    path.write_text("".join(f">{c} some words\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n" for c, s in genome().items()))
    (folder / "genes.gff3").write_text(GFF)
    return str(path), str(folder / "genes.gff3")


def matrix_lines(seed=3):
    """Two subtypes with different preferences; comments hold '>'."""
    rng, out = random.Random(seed), ["# a comment -> with a mark"]
    for subtype, pairs in (("u12", ("gtag", "atac")), ("u2", ("gtag", "gcag"))):
        for dnts in pairs:
            for region, start, width in (("five", -3, 12), ("bp", 0, 12), ("three", -6, 10)):
                if region == "bp" and dnts == "gcag":
                    continue
                out += [f">{subtype}_{dnts}_{region} start={start}", "A\tC\tG\tT"]
                for _ in range(width):
                    w = [rng.random() ** 2 + 0.02 for _ in range(4)]
                    out.append("\t".join(f"{x / sum(w):.6f}" for x in w))
    return "\n".join(out) + "\n"


def parse(lines):
    """subtype, dnts, region -> list of dicts base -> frequency."""
    out, key, bases = {}, None, None
    for line in lines.splitlines():
        if line.startswith("#"):
            continue
        if line.startswith(">"):
            key, bases = tuple(line[1:].split()[0].split("_")), None
            out[key] = []
        elif bases is None:
            bases = line.split("\t")
        else:
            out[key].append(dict(zip(bases, map(float, line.split("\t")), strict=True)))
    return out


def training(subtype, n, seed):
    """Introns drawn from the subtype's matrices, in the flat file's format."""
    rng, m, out = random.Random(seed), parse(matrix_lines()), []

    def draw(rows):
        return "".join(rng.choices("ACGT", [r[b] for b in "ACGT"])[0] for r in rows)

    for k in range(n):
        five, bp, three = (draw(m[subtype, "gtag", r]) for r in ("five", "bp", "three"))
        body = "".join(rng.choice("ACGT") for _ in range(60))
        intron = "GT" + five[5:] + body + bp + "".join(rng.choice("ACGT") for _ in range(8)) + three[:4] + "AG"
        out.append(f"{subtype}_{k}\t0.5\t{'ACGTT' + five[:3]}\t{intron}\t{three[6:] + 'ACGTA'}")
    return "\n".join(out) + "\n"
