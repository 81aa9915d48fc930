"""Sequences around introns, and the parts of them that are scored. F1-F6, J4, F16."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.config import Config
from helixframe.functions.dna import is_canonical, py_slice, reverse_complement, terminal_pair
from helixframe.sources.fasta import slices


def attach(introns: DataFrame, pieces: DataFrame, config: Config) -> DataFrame:
    """introns with upstream_flank, seq and downstream_flank in coding direction; introns of unknown contigs go.

    Only (id, place) rows meet the genome, whose contigs without introns a semi-join skips.
    """
    if config.exons_as_flanks:
        ups, downs = (F.col(f"{e}.stop") - F.col(f"{e}.start") + 1 for e in ("upstream_exon", "downstream_exon"))
    else:
        ups = downs = F.lit(config.flank)
    minus = F.col("strand") == "-"
    left, right = F.when(minus, downs).otherwise(ups), F.when(minus, ups).otherwise(downs)
    at = introns.select(F.col("intron_id").alias("id"), "region", (F.col("start") - left).alias("lo"), (F.col("stop") + right).alias("hi"), "start", "stop", "strand")
    used = pieces.join(introns.select("region").distinct(), "region", "left_semi")
    found = slices(at.select("id", "region", "lo", "hi"), used, config.chunk)
    met = introns.join(found.select(F.col("id").alias("intron_id"), F.col("seq").alias("around")), "intron_id")
    orders = pieces.select("region", "region_order").distinct()
    met = met.join(orders, "region")
    before = F.col("start") - F.greatest(F.col("start") - left, F.lit(1))
    n = F.greatest(F.col("stop") - F.col("start") + 1, F.lit(0))
    head, body, tail = F.substring("around", F.lit(1), before), F.substring("around", before + 1, n), F.substring("around", before + n + 1, F.length("around"))
    fwd = lambda a, b: F.when(minus, reverse_complement(b)).otherwise(a)
    return met.select("*", fwd(head, tail).alias("upstream_flank"), F.when(minus, reverse_complement(body)).otherwise(body).alias("seq"), fwd(tail, head).alias("downstream_flank")).drop("around")


def assign(introns: DataFrame, config: Config) -> DataFrame:
    """five_seq, three_seq, bp_region_seq, displays, dnts and noncanonical from seq and its flanks. F5, F6."""
    up, seq, down = (F.coalesce(F.col(c), F.lit("")) for c in ("upstream_flank", "seq", "downstream_flank"))
    whole = F.concat(up, seq, down)
    (f0, f1), (t0, t1), (b0, b1) = config.five_coords, config.three_coords, config.bp_coords
    five = py_slice(whole, F.length(up) + f0, F.length(up) + f1)
    end = t1 - F.length(down)
    three = py_slice(whole, t0 - F.length(down), F.when(end == 0, F.length(whole)).otherwise(end))
    n = F.length(seq)
    inner = max(f1, 0)
    first = F.when(n < abs(b0 + 1) + inner, F.lit(inner)).otherwise(n + b0)
    pair = terminal_pair(F.col("seq"))
    return introns.withColumns(
        {"five_seq": five, "three_seq": three, "bp_region_seq": py_slice(seq, F.greatest(first, F.lit(0)), F.greatest(n + b1, F.lit(0))), "five_display": F.substring(seq, 1, 10), "three_display": py_slice(seq, b1, None), "dnts": pair, "noncanonical": ~is_canonical(pair), "bp_offset": first}
    )


#: What a shiftable minor-type 5' site looks like (a fixed value).
SHIFTED = r"[AG]TATCC(?:[ACTG]T|T[ACTG])"


def splice_shift(introns: DataFrame) -> DataFrame:
    """shift: how far a noncanonical intron's 5' site lies from a minor-type motif within five bases; null for none. F16."""
    around = F.concat(py_slice(F.col("upstream_flank"), -5, None), F.substring("seq", 1, 12))
    lead = F.least(F.length("upstream_flank"), F.lit(5))
    at = F.regexp_instr(around, F.lit(SHIFTED))
    shift = F.when(F.col("noncanonical") & (at > 0), at - 1 - lead)
    return introns.withColumns({"shift": F.when(shift != 0, shift)})


def corrected(introns: DataFrame) -> DataFrame:
    """Coordinates and phase moved by shift, sequences to be cut again; a tag tells how far."""
    s, minus = F.coalesce("shift", F.lit(0)), F.col("strand") == "-"
    move = F.when(minus, -s).otherwise(s)
    phase = F.pmod(F.col("phase") + s, F.lit(3)).cast("tinyint")
    tag = F.when(F.col("shift").isNotNull(), F.concat(F.lit("[c:"), F.col("shift").cast("string"), F.lit("]")))
    return introns.withColumns({"start": F.col("start") + move, "stop": F.col("stop") + move, "phase": phase, "corrected_tag": tag})


def annotation_fixes(introns: DataFrame) -> DataFrame:
    """(line_number, start_shift, stop_shift, tag) of exon lines that corrected introns move, summed by line. C8."""
    c = introns.where("shift is not null")
    minus = F.col("strand") == "-"
    move = F.when(minus, -F.col("shift")).otherwise(F.col("shift"))
    zero = F.lit(0)
    up = c.select(F.col("upstream_exon.line_number").alias("line_number"), F.when(minus, move).otherwise(zero).alias("start_shift"), F.when(minus, zero).otherwise(move).alias("stop_shift"), "shift")
    down = c.select(F.col("downstream_exon.line_number").alias("line_number"), F.when(minus, zero).otherwise(move).alias("start_shift"), F.when(minus, move).otherwise(zero).alias("stop_shift"), "shift")
    both = up.withColumns({"coord": F.lit("stop")}).unionByName(down.withColumns({"coord": F.lit("start")}))
    return both.groupBy("line_number").agg(F.sum("start_shift").alias("start_shift"), F.sum("stop_shift").alias("stop_shift"), F.max(F.concat(F.lit("shift:"), F.col("coord"), F.lit(":"), F.col("shift").cast("string"))).alias("tag"), F.sum(F.when(F.col("coord") == "start", F.col("shift")).otherwise(0)).alias("phase_shift"))


def fixed_annotation(lines: DataFrame, fixes: DataFrame) -> DataFrame:
    """Annotation lines (value, line_number) with moved coordinates, phase and tag; others as they are. C8, K10."""
    f = F.split("value", "\t")
    met = lines.join(fixes, "line_number", "left")
    phase = F.get(f, 7)
    moved = F.when(phase.isin("0", "1", "2"), F.pmod(phase.try_cast("int") - F.col("phase_shift"), F.lit(3)).cast("string")).otherwise(phase)
    attrs = F.concat(F.get(f, 8), F.when(F.get(f, 8).endswith(";"), F.lit("")).otherwise(F.lit(";")), F.col("tag"))
    new = F.concat_ws("\t", F.slice(f, 1, 3), (F.get(f, 3).try_cast("int") + F.col("start_shift")).cast("string"), (F.get(f, 4).try_cast("int") + F.col("stop_shift")).cast("string"), F.slice(f, 6, 2), moved, attrs)
    return met.select("line_number", F.when(F.col("tag").isNotNull(), new).otherwise(F.col("value")).alias("value"))
