"""Position-weight matrices as long tables (key columns, pos, base, freq)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def letter_matrix(df: DataFrame, keys: Sequence[str], seq: str, start: int = 0, width: int | None = None, alphabet: Sequence[str] = ("A", "C", "G", "T")) -> DataFrame:
    """Frequency of each character at each place over the sequences of a group, zeros included. A6.

    Places run from start to the shortest sequence's end (or for width characters). Characters outside the alphabet
    get rows of their own. Counting is partial before the shuffle, and the shuffle holds places x characters a group.
    """
    rows = df.where(F.col(seq).isNotNull())
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.length(seq)).alias("shortest"))
    chars = F.split(F.substring(F.col(seq), 1, width) if width else F.col(seq), "")
    cells = rows.select(*keys, F.posexplode(chars).alias("at", "base")).where("base <> ''").groupBy(*keys, "at", "base").agg(F.count("*").alias("hits"))
    letters = cells.select(*keys, "base").union(sizes.select(*keys, F.explode(F.array(*map(F.lit, alphabet))).alias("base"))).distinct()
    last = F.least(F.col("shortest"), F.lit(width)) if width else F.col("shortest")
    places = sizes.where(last > 0).select(*keys, "n", F.explode(F.sequence(F.lit(0), last - 1)).alias("at"))
    full = places.join(letters, list(keys)).join(cells, [*keys, "at", "base"], "left")
    return full.select(*keys, (F.col("at") + start).cast("int").alias("pos"), "base", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("freq"))


def add_pseudocount(matrix: DataFrame, pseudo: float = 1e-4) -> DataFrame:
    """F15; a negative count undoes it."""
    return matrix.withColumns({"freq": F.col("freq") + F.lit(pseudo)})


def average(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matrices of a; where b has the key, the mean over the places that both have. J12."""
    shared = b.select(*keys).distinct().withColumns({"__in_b": F.lit(True)})
    cells = b.select(*keys, "pos", "base", F.col("freq").alias("__b"))
    met = a.join(shared, list(keys), "left").join(cells, [*keys, "pos", "base"], "left")
    met = met.where(F.col("__in_b").isNull() | F.col("__b").isNotNull())
    return met.select(*keys, "pos", "base", F.when(F.col("__in_b").isNull(), F.col("freq")).otherwise((F.col("freq") + F.col("__b")) / 2).alias("freq"))


def bounds(matrix: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest and least frequency by place. A14."""
    return matrix.groupBy(*keys, "pos").agg(F.max("freq").alias("most"), F.min("freq").alias("least"))


def length(matrix: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Places of each matrix, by its least covered base. A15."""
    return matrix.groupBy(*keys, "base").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.min("n").alias("length"))


def as_map(matrix: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a matrix, its cells as a map from 'pos|base' to frequency: bounded by the matrix's own size."""
    cell = F.struct(F.concat_ws("|", F.col("pos").cast("string"), "base").alias("k"), F.col("freq").alias("v"))
    return matrix.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(cell))).alias("cells"))


def product_score(seq: Column, cells: Column, start: int, missing: float = 1e-4) -> Column:
    """Product of the frequencies of a sequence's characters; unknown cells count `missing`, an empty text is null. F8."""
    each = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(seq), F.lit(1))),
        F.lit(1.0),
        lambda acc, i: acc * F.coalesce(F.element_at(cells, F.concat_ws("|", (i - 1 + start).cast("string"), F.substring(seq, i, F.lit(1)))), F.lit(missing)),
    )
    return F.when(F.length(seq) > 0, each)


def best_window(seq: Column, cells: Column, width: int, missing: float = 1e-4) -> Column:
    """struct(score, start, seq) of the best-scoring window, the leftmost of equals. F9."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(seq) - width, F.lit(0)))
    scored = F.transform(starts, lambda i: F.struct(product_score(F.substring(seq, i + 1, F.lit(width)), cells, 0, missing).alias("score"), (-i).alias("left"), F.substring(seq, i + 1, F.lit(width)).alias("seq")))
    best = F.array_max(scored)
    return F.when(F.length(seq) >= width, F.struct(best["score"].alias("score"), (-best["left"]).alias("start"), best["seq"].alias("seq")))


def log_ratio(a: Column, b: Column) -> Column:
    """F10."""
    return F.log2(a / b)


def to_lines(matrix: DataFrame, keys: Sequence[str], bases: Sequence[str] = ("A", "C", "G", "T"), digits: int = 15) -> DataFrame:
    """Rows of a matrix file: for each key a header, the bases, and a line a place; columns line_number and value. K9."""
    wide = matrix.groupBy(*keys, "pos").pivot("base", list(bases)).agg(F.first("freq"))
    body = F.concat_ws("\t", *[F.format_number(F.coalesce(F.col(b), F.lit(0.0)), digits) for b in bases])
    name = F.concat(F.lit(">"), F.concat_ws("_", *keys))
    first = F.min("pos").over(Window.partitionBy(*keys))
    rows = wide.withColumns({"first": first, "name": name}).withColumns({"body": body})
    head = rows.where(F.col("pos") == F.col("first")).select(*keys, F.posexplode(F.array(F.concat("name", F.lit("\tstart="), F.col("first").cast("string")), F.lit("\t".join(bases)))).alias("k", "value")).withColumns({"line": F.col("k") - 2})
    lines = rows.select(*keys, (F.col("pos") - F.col("first")).alias("line"), F.col("body").alias("value"))
    return head.select(*keys, "line", "value").unionByName(lines)
