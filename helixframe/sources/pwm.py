"""Matrix files and overlays. S9, S10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.tagging import first_match
from helixframe.sources.lines import numbered_lines

#: Words of a header that name its parts; the first that occurs wins (fixed values).
SUBTYPES = (("u12", ("u12", "12", "minor")), ("u2", ("u2", "major")))
PAIRS = (("atac", ("atac", "at-ac")), ("gtag", ("gtag", "gt-ag")), ("gcag", ("gcag", "gc-ag")))
REGIONS = (("five", ("five", "5")), ("bp", ("bp", "branch-point")), ("three", ("three", "3")))


def _part(text: Column, names) -> Column:
    holds = lambda words: [text.contains(w) for w in words]
    rules = []
    for name, words in names:
        any_ = holds(words)[0]
        for h in holds(words)[1:]:
            any_ = any_ | h
        rules.append((name, any_))
    return first_match(rules)


def read(spark: SparkSession, path: str) -> DataFrame:
    """subtype, dnts, region, version, pos, base, freq: a row a cell. A matrix file is small, a record is a window's group."""
    from pyspark.sql import Window

    lines = numbered_lines(spark, path).where(~F.col("value").startswith("#") & (F.btrim("value") != ""))
    w = Window.orderBy("line_number")
    record = F.sum(F.col("value").startswith(">").cast("int")).over(w)
    rows = lines.select("line_number", "value", record.alias("record"))
    rows = rows.withColumns({"k": F.row_number().over(Window.partitionBy("record").orderBy("line_number"))})
    head = rows.where("k = 1").select("record", F.lower("value").alias("h"), F.regexp_extract("value", r"[^A-Za-z]v\.?([^_\s]+)", 1).alias("v"), F.regexp_extract("value", r"start=(-?\d+)", 1).alias("s"))
    start = F.coalesce(F.nullif("s", F.lit("")).cast("int"), F.lit(0))
    head = head.select("record", _part(F.col("h"), SUBTYPES).alias("subtype"), _part(F.col("h"), PAIRS).alias("dnts"), _part(F.col("h"), REGIONS).alias("region"), F.nullif("v", F.lit("")).alias("version"), start.alias("start"))
    cells = F.split(F.btrim("value"), r"\s+")
    bases = rows.where("k = 2").select("record", cells.alias("bases"))
    body = rows.where("k > 2").select("record", (F.col("k") - 3).alias("at"), F.posexplode(cells).alias("i", "cell"))
    out = body.join(bases, "record").join(head, "record")
    return out.select("subtype", "dnts", "region", "version", (F.col("at") + F.col("start")).cast("int").alias("pos"), F.get("bases", F.col("i")).alias("base"), F.col("cell").cast("double").alias("freq"))


def overlay(defaults: DataFrame, custom: DataFrame) -> DataFrame:
    """Custom matrices replace the defaults of their key; if any is versioned, all defaults of its category go. S10."""
    key = ["subtype", "dnts", "region"]
    versioned = custom.where("version is not null").select(*key).distinct()
    rest = defaults.join(versioned, key, "left_anti")
    same = custom.select(*key, F.col("version").alias("__v")).distinct().withColumnsRenamed({k: f"__{k}" for k in key})
    on = [F.col(k) == F.col(f"__{k}") for k in key] + [F.col("version").eqNullSafe(F.col("__v"))]
    return rest.join(same, on, "left_anti").unionByName(custom)
