"""Relational operators that the splice analysis is built from; all are plans of built-in functions.

None collects rows, and none gathers a group in one task unless a window's partition is that group by definition.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stretches that a group's values are dealt to where they are added up in order.
BLOCKS = 512


def adjacent_pairs(df: DataFrame, keys: Sequence[str], order: Sequence[Column], fields: Sequence[str]) -> DataFrame:
    """Each row with the next one of its group as struct `next` (null at the end). W1."""
    return df.withColumns({"next": F.lead(F.struct(*fields)).over(Window.partitionBy(*keys).orderBy(*order))})


def ordered_dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column], id_: str) -> DataFrame:
    """Adds winner (the first row's id) and place within the rows of equal keys. W3."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"winner": F.first(id_).over(w), "place": F.row_number().over(w)})


def first_of_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Adds the value of each group's first row. W4."""
    return df.withColumns({name: F.first(value).over(Window.partitionBy(*keys).orderBy(*order))})


def family_size(df: DataFrame, keys: Sequence[str], name: str = "family_size") -> DataFrame:
    """Siblings of each row, itself included. A2. A partial count and an equi-join: a group may hold any share of rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias(name))
    return df.join(counts, list(keys))


def fraction_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column], amount: str, name: str = "fraction") -> DataFrame:
    """Running share of the group's sum, in percent, half-even to three places. W8."""
    w = Window.partitionBy(*keys)
    run = F.sum(amount).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({name: F.bround(run / F.sum(amount).over(w) * 100, 3)})


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Two intervals share more than an end. P8."""
    return (a0 - b1) * (a1 - b0) < 0


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], span: tuple[str, str], other: tuple[str, str], width: int, how: str = "inner") -> DataFrame:
    """Closed intervals of left and right that meet within equal keys. J5.

    Intervals are dealt to the bins of `width` that they touch, so the join is an equi-join; a pair is reported in the
    first bin that both touch. how: inner (all columns; right ones must differ in name), left_semi or left_anti.
    """
    ids = left.withColumns({"__row": F.struct(*left.columns)})
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width).cast("bigint"), F.floor(F.col(b) / width).cast("bigint")))
    a = ids.withColumns({"__bin": bins(*span)})
    b = right.withColumns({"__other_bin": bins(*other)}).withColumns({f"__k{i}": F.col(k) for i, k in enumerate(keys)}).drop(*keys)
    on = [F.col("__bin") == F.col("__other_bin"), F.col(span[0]) <= F.col(other[1]), F.col(span[1]) >= F.col(other[0])]
    on += [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)]
    met = a.join(b, on)
    first = F.greatest(F.floor(F.col(span[0]) / width), F.floor(F.col(other[0]) / width))
    met = met.where(F.col("__bin") == first)
    if how == "inner":
        return met.drop("__bin", "__other_bin", "__row", *[f"__k{i}" for i in range(len(keys))])
    hit = met.select("__row").distinct()
    return ids.join(hit, "__row", how).drop("__row")


def top_share(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent values with their share of all rows in percent; ties by value. O3."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumns({"pct": F.round(F.col("n") * 100.0 / total, 4)}).orderBy(F.desc("n"), key).limit(k)


def z_scores(df: DataFrame, value: str, reference: Column, name: str = "z") -> DataFrame:
    """(x - mean) / population deviation of the reference rows; a deviation of 0 counts as 1. A17."""
    fit = df.where(reference).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__sd"))
    sd = F.when(F.col("__sd") == 0, 1.0).otherwise(F.col("__sd"))
    return df.crossJoin(F.broadcast(fit)).withColumns({name: (F.col(value) - F.col("__mean")) / sd}).drop("__mean", "__sd")


def accumulated(counts: DataFrame, keys: Sequence[str], value: str, amounts: Sequence[str]) -> DataFrame:
    """counts (one row for each value of a group) with run_x, the sum of x up to that value, and all_x, for each x of amounts.

    Values are dealt to BLOCKS equal stretches of their group's range, and the stretches' sums are added up first: a
    window holds the values of one stretch, not those of a group.
    """
    ends = counts.groupBy(*keys).agg(F.min(value).cast("double").alias("__low"), F.max(value).cast("double").alias("__high"))
    met = counts.join(ends, list(keys)) if keys else counts.crossJoin(F.broadcast(ends))  # without keys, one row
    share = F.try_divide(F.col(value).cast("double") - F.col("__low"), F.col("__high") - F.col("__low"))
    met = met.withColumns({"__block": F.coalesce(F.when(~F.isnan(share), F.floor(share * BLOCKS)), F.lit(0)).cast("bigint")})
    own = Window.partitionBy(*keys, "__block").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = met.groupBy(*keys, "__block").agg(*[F.sum(x).alias(f"__of_{x}") for x in amounts])
    sums = sums.withColumns({f"__before_{x}": F.coalesce(F.sum(f"__of_{x}").over(before), F.lit(0)) for x in amounts} | {f"all_{x}": F.sum(f"__of_{x}").over(Window.partitionBy(*keys)) for x in amounts})
    run = met.withColumns({f"__run_{x}": F.sum(x).over(own) for x in amounts}).join(sums, [*keys, "__block"])
    return run.select(*keys, value, *amounts, *[(F.col(f"__run_{x}") + F.col(f"__before_{x}")).alias(f"run_{x}") for x in amounts], *[f"all_{x}" for x in amounts])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(keys, q): the exact quantiles of each group's values, in the order of shares, linearly interpolated; nulls don't
    count. No buffer holds a group's values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    rows = accumulated(counts, keys, value, ["n"])
    found = []
    for i, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("all_n") - 1)
        found += [F.min(F.when(F.col("run_n") > F.floor(at), F.col(value))).alias(f"a{i}"), F.min(F.when(F.col("run_n") > F.ceil(at), F.col(value))).alias(f"z{i}"), F.first(at).alias(f"at{i}")]
    met = rows.groupBy(*keys).agg(*found)

    def between(i: int) -> Column:
        low, high, at = F.col(f"a{i}").cast("double"), F.col(f"z{i}").cast("double"), F.col(f"at{i}")
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return met.select(*keys, F.array(*[between(i) for i in range(len(shares))]).alias("q"))


def robust_scores(df: DataFrame, value: str, reference: Column | None = None, name: str = "z") -> DataFrame:
    """(x - median) / interquartile range, exact quantiles with linear interpolation. A18."""
    fit = quantiles(df if reference is None else df.where(reference), [], value, [0.25, 0.5, 0.75]).withColumnRenamed("q", "__q")
    spread = F.col("__q")[2] - F.col("__q")[0]
    return df.crossJoin(F.broadcast(fit)).withColumns({name: (F.col(value) - F.col("__q")[1]) / F.when(spread == 0, 1.0).otherwise(spread)}).drop("__q")


def below_percentile(df: DataFrame, keys: Sequence[str], value: str, share: float) -> DataFrame:
    """Rows below their group's exact percentile. A10."""
    cut = quantiles(df, keys, value, [share]).select(*keys, F.col("q")[0].alias("cut"))
    return df.join(cut, list(keys)).where(F.col(value) < F.col("cut"))


def geometric_mean(value: Column) -> Column:
    """A16."""
    return F.exp(F.avg(F.ln(value)))


def upsert(*layers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union by key, later layers winning. U2."""
    all_ = None
    for i, layer in enumerate(layers):
        layer = layer.withColumns({"__layer": F.lit(i)})
        all_ = layer if all_ is None else all_.unionByName(layer)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__layer")))
    return all_.withColumns({"__n": last}).where("__n = 1").drop("__layer", "__n")


def linear_score(features: Sequence[str], weights: Sequence[float | Decimal], bias: float) -> Column:
    """The margin of a linear model. A Decimal times a feature of whole numbers is exact before it is added. M4."""
    out = F.lit(float(bias))
    for f, w in zip(features, weights, strict=True):
        out = out + (F.col(f) * F.lit(w if isinstance(w, Decimal) else float(w))).cast("double")
    return out


def weighted_votes(probabilities: Sequence[Column], weights: Sequence[float]) -> Column:
    """Mean of model outputs, each times its weight; the weights aren't normalised. A21."""
    out = F.lit(0.0)
    for p, w in zip(probabilities, weights, strict=True):
        out = out + p * F.lit(float(w))
    return out / len(probabilities)


def confusion(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """tp, fp, fn, tn and F1. A22."""
    out = df.agg(F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn"))
    return out.withColumns({"f1": F.try_divide(F.col("tp") * 2.0, F.col("tp") * 2.0 + F.col("fp") + F.col("fn"))})


def precision_recall(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Precision and recall at each distinct score, from the top; rows without a score don't count. A22."""
    scored = df.where(F.col(score).isNotNull())
    by = scored.groupBy(score).agg(F.coalesce(F.sum(F.col(truth).cast("int")), F.lit(0)).alias("p"), F.count("*").alias("n"))
    # from the top: all but what lies below
    upward = lambda x: F.col(f"all_{x}") - F.col(f"run_{x}") + F.col(x)
    return accumulated(by, [], score, ["p", "n"]).select(score, (upward("p") / upward("n")).alias("precision"), F.try_divide(upward("p"), F.col("all_p")).alias("recall"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows in equal bins of [low, high); values outside go to bins 0 and bins + 1. K15."""
    at = F.when(F.col(value) < low, 0).when(F.col(value) >= high, bins + 1).otherwise(F.floor((F.col(value) - low) * bins / (high - low)) + 1)
    return df.where(F.col(value).isNotNull()).groupBy(at.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def grid_bins(df: DataFrame, x: str, y: str, x_step: float, y_step: float) -> DataFrame:
    """Rows in the cells of a grid, with the logarithm of their number. K15."""
    cell = lambda c, s: F.floor(F.col(c) / s).cast("bigint")
    return df.groupBy(cell(x, x_step).alias("x_bin"), cell(y, y_step).alias("y_bin")).agg(F.count("*").alias("n")).withColumns({"log_n": F.round(F.log10("n"), 6)})


def roll_up(children: DataFrame, parents: DataFrame, key: str, parent_key: str, sums: dict[str, str]) -> DataFrame:
    """Parents with sums over their children (null without any). A1."""
    per = children.groupBy(F.col(key).alias(parent_key)).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return parents.join(per, parent_key, "left")
