"""Intron sequence files: name, columns that begin with a digit or are a dot, 5' exon, intron, 3' exon. S6-S8, S12."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.sources.lines import numbered_lines


def read(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """intron_id (line order), name, upstream_flank, seq, downstream_flank, flank, type_id (the label). S6, S7."""
    lines = numbered_lines(spark, path).where(~F.col("value").startswith("#") & (F.btrim("value") != ""))
    f = F.split("value", "\t")
    kept = F.filter(F.slice(f, 2, F.greatest(F.size(f) - 1, F.lit(0))), lambda x: ~(x.rlike("^[0-9]") | (x == ".")))
    rows = lines.select("line_number", F.get(f, 0).alias("given"), kept.alias("k"))
    rows = rows.withColumns({"k": F.when(F.size("k") >= 3, F.col("k")).otherwise(F.raise_error(F.concat(F.lit("fewer than three sequences in line "), (F.col("line_number") + 1).cast("string"))))})
    auto = (F.btrim("given") == "") | F.lit("-.*_").contains(F.col("given"))
    rows = rows.withColumns({"auto": auto})
    k = F.sum(F.col("auto").cast("int")).over(Window.orderBy("line_number"))
    name = F.when(F.col("auto"), F.concat(F.lit("auto_intron_"), k.cast("string"))).otherwise(F.col("given"))
    unnamed = rows.where("auto").select("line_number", name.alias("name"))
    named = rows.where("not auto").select("line_number", F.col("given").alias("name"))
    seqs = [F.upper(F.get("k", i)) for i in range(3)]
    out = rows.select("line_number", *[s.alias(n) for s, n in zip(seqs, ("upstream_flank", "seq", "downstream_flank"), strict=True)]).join(unnamed.unionByName(named), "line_number")
    return out.select(F.col("line_number").cast("bigint").alias("intron_id"), "name", "upstream_flank", "seq", "downstream_flank", F.greatest(F.length("upstream_flank"), F.length("downstream_flank")).alias("flank"), F.lit(label).cast("string").alias("type_id"))


def read_for_builder(spark: SparkSession, path: str) -> DataFrame:
    """five, seq, three of lines with exactly three sequences among columns 2 to 5. S12."""
    f = F.split("value", "\t")
    kept = F.filter(F.slice(f, 2, 4), lambda x: ~x.rlike(r"^[.\-*\s0-9]") & (x != ""))
    lines = numbered_lines(spark, path).where(~F.col("value").startswith("#")).select(kept.alias("k")).where(F.size("k") == 3)
    return lines.select(*[F.upper(F.get("k", i)).alias(n) for i, n in enumerate(("five", "seq", "three"))])
