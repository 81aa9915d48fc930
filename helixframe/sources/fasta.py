"""Genome FASTA as chunks that any executor can slice. S1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """(region, seq, region_order): one row a contig, named by the header's first word, in file order, upper case."""
    # a record begins with > at the start of a line; the file's first has no line break before it
    value = F.regexp_replace("value", "^>", "")
    raw = spark.read.text(path, lineSep="\n>").select(value.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    raw = raw.where(F.btrim("value") != "")
    header = F.regexp_extract("value", r"^\s*(\S*)", 1)
    body = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"#[^\n]*|\s+", ""))
    order = F.row_number().over(Window.orderBy("file", "block", "at")).cast("int")  # one row a contig
    names = raw.select("file", "block", "at", order.alias("region_order"))
    return raw.select("file", "block", "at", header.alias("region"), body.alias("seq")).join(names, ["file", "block", "at"]).select("region", "seq", "region_order")


def chunks(genome: DataFrame, size: int) -> DataFrame:
    """(region, region_order, region_length, chunk, seq): pieces of so many bases, numbered from 0."""
    n = F.length("seq")
    at = F.sequence(F.lit(0), F.greatest(F.ceil(n / size).cast("int") - 1, F.lit(0)))
    return genome.select("region", "region_order", n.alias("region_length"), "seq", F.explode(at).alias("chunk")).select("region", "region_order", "region_length", "chunk", F.substring("seq", F.col("chunk") * size + 1, F.lit(size)).alias("seq"))


def slices(wanted: DataFrame, pieces: DataFrame, size: int) -> DataFrame:
    """wanted (id, region, lo, hi; 1-based closed, any extent) with seq, cut at the contig's ends. J4.

    A slice meets only the chunks it spans, so a long contig is many rows of an equi-join, never one.
    """
    first, last = F.floor((F.greatest("lo", F.lit(1)) - 1) / size), F.floor((F.greatest("hi", F.lit(1)) - 1) / size)
    spread = wanted.select("id", "region", F.greatest("lo", F.lit(1)).alias("lo"), "hi", F.explode(F.sequence(first, last)).alias("chunk"))
    met = spread.join(pieces, ["region", "chunk"])
    begin = F.greatest(F.col("lo") - F.col("chunk") * size, F.lit(1))
    stop = F.least(F.col("hi") - F.col("chunk") * size, F.lit(size))
    part = F.struct("chunk", F.substring("seq", begin.cast("int"), F.greatest(stop - begin + 1, F.lit(0)).cast("int")).alias("seq"))
    return met.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["seq"]), "").alias("seq"))
