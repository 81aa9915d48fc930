"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1]. Its integral is the source's weight; the weights
share a budget of words, no source above a multiple of its size. The integral up to t, scaled to the target, is the
source's cumulative demand; inverting it at a document's place in the source's own (hashed, fixed) order gives the
training position of each copy. Positions are what the documents are range-sorted by.

Scale: only (doc_id, source, size, hash) is shuffled. Running sums are taken in two levels, within 4,096 hash buckets
of a source and over the buckets' sums, so a source with a third of all rows is spread over as many tasks as it has
buckets. Per-source tables have one row a source.

Defined results: a null source is a source of its own, last in order; a null or empty text has size 0 and is taken for
0 words; repeated rows count each; an empty table gives an empty table; extra columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


@dataclass(frozen=True)
class Schedule:
    """A weight and its course: linear between (time, factor) knots. Factors are scaled so that their integral is 1."""

    weight: int
    knots: tuple[tuple[float, float], ...] = ((0.0, 1.0), (1.0, 1.0))

    def pieces(self) -> list[tuple[float, float, float, float, float]]:
        """(start, length, factor at start, slope, share of demand before), one for each stretch."""
        spans = [(a[0], b[0] - a[0], a[1], (b[1] - a[1]) / (b[0] - a[0])) for a, b in zip(self.knots, self.knots[1:], strict=False)]
        areas = [n * (f + k * n / 2) for _, n, f, k in spans]
        total = sum(areas)
        return [(t, n, f / total, k / total, sum(areas[:i]) / total) for i, (t, n, f, k) in enumerate(spans)]

    def time_of(self, share: Column) -> Column:
        """The time by which `share` of the demand has come: the inverse of the schedule's integral."""
        out = F.lit(0.0)
        for t, n, f, k, before in self.pieces():
            y = F.greatest(share - before, F.lit(0.0))
            step = y / f if k == 0 else 2 * y / (f + F.sqrt(F.greatest(F.lit(f * f) + 2 * k * y, F.lit(0.0))))
            out = F.when(share >= before, F.lit(t) + F.least(step, F.lit(n))).otherwise(out)
        return out


#: The contract's weights by rank of the source: one fades in, one is level, one fades out.
CURRICULUM = (
    Schedule(3, ((0.0, 0.5), (1.0, 1.5))),
    Schedule(1),
    Schedule(2, ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5))),
)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def sizes(docs: DataFrame, seed: str = "") -> DataFrame:
    """doc_id, source, size and a hash of doc_id that fixes the order in which a source is used."""
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    h = F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint")
    return docs.select("doc_id", F.xxhash64("text").alias("tag"), F.col("source").cast("string").alias("source"), word_count().alias("size"), h.alias("h")).withColumns(
        {"bucket": F.shiftright("h", 48).cast("int"), "no_source": F.col("source").isNull(), "source_key": F.coalesce("source", F.lit(""))}
    )


def targets(by_source: DataFrame, curriculum: tuple[Schedule, ...], budget: float, cap: float) -> DataFrame:
    """by_source (no_source, source_key, source_size) with rank, weight and target.

    Shares of budget * all sizes by weight, none above cap * its size. Sources sorted by cap / weight fill up in that
    order, so the level at which the others stop is the largest of the levels found at each prefix.
    """
    everything = Window.partitionBy()
    ranked = by_source.withColumns({"rank": F.row_number().over(Window.orderBy("no_source", "source_key")) - 1})
    weight = F.element_at(F.array(*[F.lit(s.weight) for s in curriculum]), (F.col("rank") % len(curriculum) + 1).cast("int"))
    order = Window.orderBy((F.col("source_size") * cap) / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    filled, used = F.coalesce(F.sum(F.col("source_size") * cap).over(order), F.lit(0.0)), F.coalesce(F.sum("weight").over(order), F.lit(0))
    level = (F.sum("source_size").over(everything) * budget - filled) / (F.sum("weight").over(everything) - used)
    out = ranked.withColumns({"weight": weight}).withColumns({"level": level}).withColumns({"level": F.max("level").over(everything)})
    return out.withColumns({"target": F.least(F.col("source_size") * cap, F.col("level") * F.col("weight"))}).drop("level")


def assign(docs: DataFrame, curriculum: tuple[Schedule, ...] = CURRICULUM, budget: float = 1.5, cap: float = 2.0, seed: str = "") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, and copies, an array of

    (copy, words, position): how many of the document's words that pass over its source takes, and when.
    A source's passes take floor(target) words in all; the last document they reach may be taken in part.
    """
    of_doc = sizes(docs, seed)
    key = ["no_source", "source_key"]
    buckets = of_doc.groupBy(*key, "bucket").agg(F.sum("size").alias("in_bucket"))
    so_far = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumns({"bucket_start": F.coalesce(F.sum("in_bucket").over(so_far), F.lit(0))}).drop("in_bucket")
    aims = targets(buckets.groupBy(*key).agg(F.sum("in_bucket").alias("source_size")), curriculum, budget, cap)
    at = Window.partitionBy(*key, "bucket").orderBy("h", "doc_id", "size", "tag").rowsBetween(Window.unboundedPreceding, -1)
    placed = of_doc.withColumns({"before": F.coalesce(F.sum("size").over(at), F.lit(0))})
    placed = placed.join(starts, [*key, "bucket"]).join(aims, key).withColumns({"before": F.col("before") + F.col("bucket_start")})
    whole = F.floor("target")
    position = lambda share: F.element_at(F.array(*[s.time_of(share) for s in curriculum]), (F.col("rank") % len(curriculum) + 1).cast("int"))

    def copy(k: int) -> Column:
        start = F.col("before") + k * F.col("source_size")
        words = F.least(F.greatest(whole - start, F.lit(0)), F.col("size")).cast("bigint")
        share = F.least(start / F.greatest(F.col("target"), F.lit(1e-300)), F.lit(1.0))
        return F.struct(F.lit(k).alias("copy"), words.alias("words"), position(share).alias("position"))

    passes = range(max(1, -int(-cap // 1)))
    out = placed.withColumns({"copies": F.filter(F.array(*[copy(k) for k in passes]), lambda c: c["words"] > 0)})
    taken = F.aggregate("copies", F.lit(0).cast("bigint"), lambda a, c: a + c["words"])
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies", "tag")


def in_order(plan: DataFrame) -> DataFrame:
    """assign()'s rows range-sorted by training position, with two more columns: when the first copy is due (null: none
    is), and when the second."""
    due = lambda i: F.get(F.col("copies"), F.lit(i))["position"]
    placed = plan.withColumns({"position": due(0), "again": due(1)})
    return placed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def mix(docs: DataFrame, curriculum: tuple[Schedule, ...] = CURRICULUM, budget: float = 1.5, cap: float = 2.0, seed: str = "") -> DataFrame:
    """The training stream: a row for each copy that the mix takes, with the columns of docs, range-sorted by position.

    A copy taken in part keeps its first words and the spaces between them. Rows equal in doc_id and text are one
    document, taken as often as they are together.
    """
    plan = assign(docs, curriculum, budget, cap, seed).select(F.col("doc_id").alias("__id"), F.col("tag").alias("__of"), F.col("size").alias("__size"), F.explode("copies").alias("__copy"))
    rows = docs.withColumns({"__tag": F.xxhash64("text")}).dropDuplicates(["doc_id", "__tag"])
    rows = rows.join(plan, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__tag") == F.col("__of")))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("__copy.words").cast("int")), "")
    text = F.when(F.col("__copy.words") < F.col("__size"), cut).otherwise(F.col("text"))
    out = rows.select(F.col("__copy.position").alias("__position"), F.col("__copy.copy").alias("__pass"), *[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    return out.repartitionByRange("__position", "doc_id", "__pass").sortWithinPartitions("__position", "doc_id", "__pass").drop("__position", "__pass")
