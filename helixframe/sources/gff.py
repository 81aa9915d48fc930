"""GFF3 and GTF annotations. S2-S4."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.sources.lines import numbered_lines


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a conforming line: the nine columns typed, name, parents and grandparent from either attribute dialect."""
    f = F.split("value", "\t")
    rows = numbered_lines(spark, path).where(~F.col("value").startswith("#")).select("line_number", "value", f.alias("f")).where(F.size("f") >= 9)
    rows = rows.select("line_number", F.get("f", 0).alias("region"), F.lower(F.get("f", 2)).alias("kind"), F.get("f", 3).try_cast("int").alias("a"), F.get("f", 4).try_cast("int").alias("b"), F.get("f", 6).alias("strand"), F.get("f", 7).try_cast("tinyint").alias("phase"), F.get("f", 8).alias("attr"))
    rows = rows.where("a is not null and b is not null and strand in ('+', '-')")
    key = lambda k: F.nullif(F.regexp_extract("attr", rf"(?:^|;)\s*{k}=([^;]*)", 1), F.lit(""))
    quoted = lambda k: F.nullif(F.regexp_extract("attr", rf"""(?:^|;)\s*{k}\s+"([^"]*)\"""", 1), F.lit(""))
    gtf = quoted("gene_id").isNotNull()
    gene = (F.col("kind") == "gene") & gtf
    leaf = F.col("kind").isin("exon", "cds")
    name = F.when(gene, quoted("gene_id")).when(gtf & ~leaf, quoted("transcript_id")).otherwise(F.btrim(key("ID")))
    one = F.when(gene, None).when(leaf, quoted("transcript_id")).otherwise(quoted("gene_id"))
    parents = F.when(gtf, F.filter(F.array(one), lambda p: p.isNotNull())).otherwise(F.split(key("Parent"), ","))
    grand = F.when(gtf & leaf, quoted("gene_id")).otherwise(F.coalesce(key("gene_id"), key("geneID")))
    return rows.select("line_number", "region", "kind", F.least("a", "b").alias("start"), F.greatest("a", "b").alias("stop"), "strand", "phase", name.alias("name"), parents.alias("parents"), grand.alias("grandparent"))


def normalise(rows: DataFrame) -> DataFrame:
    """A row for each parent (one for none); kinds other than gene, exon and cds are transcripts. S3."""
    kind = F.when(F.col("kind").isin("gene", "exon", "cds"), F.col("kind")).otherwise("transcript")
    out = rows.select("*", kind.alias("feat_type"), F.explode_outer("parents").alias("parent")).drop("kind", "parents")
    return out.withColumns({"grandparent": F.nullif("grandparent", "parent")})


def has_feature(rows: DataFrame, kinds: Sequence[str]) -> bool:
    """Stops at the first line that has one of the kinds. S4."""
    return not rows.where(F.col("kind").isin(*kinds)).limit(1).isEmpty()


def usable_features(rows: DataFrame, asked: Sequence[str]) -> tuple[str, ...]:
    """The asked kinds that occur, else cds, else exon."""
    for kinds in (tuple(asked), ("cds",), ("exon",)):
        if found := tuple(k for k in kinds if has_feature(rows, [k])):
            return found
    raise ValueError("the annotation has neither exon nor cds features")
