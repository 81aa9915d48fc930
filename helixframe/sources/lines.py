"""Text lines with their number in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line_number (0-based in its file).

    A scan knows where its block starts and the order of lines in it; numbers in a block are offset by the counts of the
    file's blocks before it. The sort is by block, so a large file is numbered in parallel.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    placed = raw.withColumns({"n": F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))})
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = raw.groupBy("file", "block").agg(F.count("*").alias("lines")).withColumns({"first": F.coalesce(F.sum("lines").over(before), F.lit(0))})
    return placed.join(starts.select("file", "block", "first"), ["file", "block"]).select("value", (F.col("first") + F.col("n") - 1).cast("int").alias("line_number"))
