"""BED intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.sources.lines import numbered_lines


def closed(start: Column, stop: Column) -> tuple[Column, Column]:
    """0-based half-open to 1-based closed, ends in order."""
    return F.least(start, stop) + 1, F.greatest(start, stop)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Introns (region, start, stop, name, strand, line_number) of a BED file; rows that aren't intervals are skipped. S5."""
    lines = numbered_lines(spark, path).where(~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    rows = lines.select("line_number", f.alias("f")).where(F.size("f") >= 6)
    rows = rows.select("line_number", *[F.get("f", i).alias(n) for i, n in enumerate(("region", "a", "b", "name", "score", "strand"))])
    rows = rows.withColumns({"a": F.col("a").try_cast("int"), "b": F.col("b").try_cast("int"), "strand": F.btrim("strand")}).where("a is not null and b is not null and strand in ('+', '-')")
    start, stop = closed(F.col("a"), F.col("b"))
    unnamed = F.lit("-.*").contains(F.col("name"))
    name = F.when(unnamed, F.concat(F.lit("i_"), (F.col("line_number") + 1).cast("string"))).otherwise(F.col("name"))
    return rows.select("line_number", "region", start.alias("start"), stop.alias("stop"), name.alias("name"), "strand")
