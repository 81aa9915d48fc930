"""Queries that run the intron operators and reports on introns made from `orders`, with SQL that gives the same rows.

An order is an intron: its customer is the contig and the transcript, its bases are hexadecimal digests spelt in A, C,
G and T, and its priority says which terminal pair it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.config import Config
from helixframe.functions import dna, report
from helixframe.operators import hierarchy, sequences, tagging
from helixframe.plans import sinks
from helixframe.plans.driver_queries import query
from helixframe.session import table

HEX = "0123456789abcdef"
#: With N for every tenth digit of some orders.
PLAIN, WITH_N = "ACGTACGTACGTACGT", "ACGTACGTACGTACGN"
MIN_LENGTH, BP_LENGTH = 30, 12

SQL = f"""d AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS key, CAST(20 + o_orderkey % 4 * 20 AS INTEGER) AS n FROM orders),
b AS (SELECT *, translate(md5('a' || key) || md5('b' || key) || md5('c' || key), '{HEX}', CASE WHEN o_orderkey % 11 = 0 THEN '{WITH_N}' ELSE '{PLAIN}' END) AS bases FROM d),
i AS (SELECT o_orderkey AS intron_id, o_custkey, 'c' || o_custkey AS region, CASE o_orderstatus WHEN 'F' THEN '-' ELSE '+' END AS strand,
  1000 + o_orderkey * 7919 % 5 * 20 AS start, 1000 + o_orderkey * 7919 % 5 * 20 + n - 1 AS stop, n AS length, 't' || o_custkey AS transcript, 'g' || o_custkey // 4 AS gene,
  substr(bases, 80, 5) AS up, substr(bases, 88, 5) AS down, o_orderkey % 9 AS line_number, o_orderkey % 6 AS idx, 1 + o_orderkey % 5 AS family_size, 100 * (o_custkey % 3) AS parent_length,
  CASE WHEN o_orderkey % 7 < 4 THEN 'cds' ELSE 'exon' END AS defined_by, o_orderkey % 3 AS phase, CASE WHEN o_orderkey % 13 = 0 THEN 's' END AS omit1,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'GT' || substr(bases, 1, n - 4) || 'AG' WHEN '2' THEN 'GC' || substr(bases, 1, n - 4) || 'AG' WHEN '3' THEN 'AT' || substr(bases, 1, n - 4) || 'AC' ELSE substr(bases, 1, n) END AS seq FROM b),
s AS (SELECT *, substr(up || seq || down, 3, 12) AS five_seq, substr(up || seq || down, length, 10) AS three_seq, substr(seq, CASE WHEN length < 63 THEN 10 ELSE length - 54 END, length - 5 - CASE WHEN length < 63 THEN 9 ELSE length - 55 END) AS bp_region_seq,
  substr(seq, 1, 10) AS five_display, right(seq, 5) AS three_display, substr(seq, 1, 2) || '-' || right(seq, 2) AS dnts FROM i),
p AS (SELECT *, dnts NOT IN ('GT-AG', 'GC-AG', 'AT-AC') AS noncanonical, coalesce(list_max(list_transform(regexp_extract_all(bp_region_seq, '[ACGT]+'), lambda x: length(x))), 0) AS run FROM s),
o AS (SELECT *, CASE WHEN length < {MIN_LENGTH} THEN 's' WHEN regexp_matches(five_seq, '[^ACGT]') OR regexp_matches(three_seq, '[^ACGT]') THEN 'a'
  WHEN run < {BP_LENGTH} AND length(bp_region_seq) < {BP_LENGTH} THEN 's' WHEN run < {BP_LENGTH} THEN 'a' WHEN noncanonical THEN 'n' END AS omitted FROM p)"""
RANK = "defined_by, parent_length DESC, transcript, family_size DESC, idx, line_number, intron_id"
SAME = f"WINDOW same AS (PARTITION BY region, strand, omit1 IS NULL, start, stop ORDER BY {RANK}), met AS (PARTITION BY gene ORDER BY o_custkey, {RANK}), placed AS (PARTITION BY region, strand ORDER BY {RANK})"
TAGS = f"""t AS (SELECT *, CASE WHEN first_value(intron_id) OVER same <> intron_id THEN first_value(intron_id) OVER same END AS duplicate,
  transcript IS NOT DISTINCT FROM first_value(transcript) OVER met AS longest_isoform, row_number() OVER placed AS place FROM i {SAME})"""
SCORED = """x AS (SELECT *, 'HomSap-' || transcript || '-' || idx AS name, CASE WHEN omitted IS NULL THEN CAST(intron_id % 400 AS DOUBLE) / 4 END AS svm_score, CASE WHEN omitted IS NULL THEN CAST(intron_id % 400 AS DOUBLE) / 4 - 90 END AS relative_score,
  CASE WHEN omitted IS NULL THEN substr(bp_region_seq, 3, 7) END AS bp_seq, CASE WHEN omitted IS NULL THEN substr(bp_region_seq, 1, 4) END AS bp_seq_u2, CASE WHEN omitted IS NULL THEN CASE WHEN intron_id % 400 > 360 THEN 'u12' ELSE 'u2' END END AS type_id, CAST(intron_id % 100 AS DOUBLE) AS fractional_position FROM o)"""


def _dot(*columns: str) -> str:
    return "concat_ws(chr(9), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '.')" for c in columns) + ")"


MOTIF = "right(up, 3) || '|' || concat_ws('...', five_display, bp_seq || '/' || bp_seq_u2, three_display) || '|' || substr(down, 1, 3)"
CONTEXT = "substr(bp_region_seq, 1, 2) || '[' || bp_seq || ']' || substr(bp_region_seq, 3 + length(bp_seq))"


def _introns(spark, d) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    digits = F.concat(*[F.md5(F.concat(F.lit(x), key).cast("binary")) for x in "abc"])
    odd = F.col("o_orderkey") % 11 == 0
    rows = table(spark, d, "orders").withColumns({"n": (20 + F.col("o_orderkey") % 4 * 20).cast("int"), "bases": F.when(odd, F.translate(digits, HEX, WITH_N)).otherwise(F.translate(digits, HEX, PLAIN))})
    inner, kind, k, c = F.substring("bases", F.lit(1), F.col("n") - 4), F.substring("o_orderpriority", 1, 1), F.col("o_orderkey"), F.col("o_custkey")
    seq = F.substring("bases", F.lit(1), F.col("n"))
    for digit, (a, z) in {"1": ("GT", "AG"), "2": ("GC", "AG"), "3": ("AT", "AC")}.items():
        seq = F.when(kind == digit, F.concat(F.lit(a), inner, F.lit(z))).otherwise(seq)
    named = lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    start = 1000 + k * 7919 % 5 * 20
    # a generated row, so that filters aren't pushed into the digests, as they wouldn't be into sequences cut from a genome
    cut = F.struct(seq.alias("seq"), F.substring("bases", 80, 5).alias("upstream_flank"), F.substring("bases", 88, 5).alias("downstream_flank"))
    return rows.select("*", F.inline(F.array(cut))).select(
        k.alias("intron_id"), c.alias("region_order"), named("c", c).alias("region"), F.when(F.col("o_orderstatus") == "F", "-").otherwise("+").alias("strand"),
        start.alias("start"), (start + F.col("n") - 1).alias("stop"), dna.span_length(start, start + F.col("n") - 1, F.col("seq")).alias("length"), named("t", c).alias("transcript"), named("g", F.floor(c / 4)).alias("gene"),
        "seq", "upstream_flank", "downstream_flank", (k % 9).alias("line_number"), (k % 6).alias("idx"), (1 + k % 5).alias("family_size"), (100 * (c % 3)).alias("parent_length"),
        F.when(k % 7 < 4, "cds").otherwise("exon").alias("defined_by"), (k % 3).alias("phase"), F.when(k % 13 == 0, F.lit("s")).alias("omit1"),
    )


def _sites(spark, d) -> DataFrame:
    return sequences.assign(_introns(spark, d), Config(species="homo_sapiens", sequences="orders"))


def _omitted(spark, d) -> DataFrame:
    rule = tagging.omission(MIN_LENGTH, BP_LENGTH, ("five", "bp", "three"), False, True, False)
    return _sites(spark, d).withColumns({"omitted": rule})


def _scored(spark, d) -> DataFrame:
    k, known = F.col("intron_id"), F.col("omitted").isNull()
    part = lambda a, n: F.when(known, F.substring("bp_region_seq", a, n))
    score = F.when(known, (k % 400).cast("double") / 4)
    columns = {"name": F.concat(F.lit("HomSap-"), "transcript", F.lit("-"), F.col("idx").cast("string")), "svm_score": score, "relative_score": score - 90, "bp_seq": part(3, 7), "bp_seq_u2": part(1, 4), "bp_start": F.lit(2)}
    return _omitted(spark, d).withColumns(columns | {"type_id": F.when(known, F.when(k % 400 > 360, "u12").otherwise("u2")), "fractional_position": (k % 100).cast("double")})


@query(f"WITH {SQL} SELECT intron_id, CAST(length AS BIGINT) AS length, five_seq, three_seq, bp_region_seq, five_display, three_display, dnts, noncanonical FROM p")
def scored_sites(spark, d):
    return _sites(spark, d).select("intron_id", F.col("length").cast("bigint").alias("length"), "five_seq", "three_seq", "bp_region_seq", "five_display", "three_display", "dnts", "noncanonical")


@query(f"""WITH {SQL} SELECT dnts, (a = m)::INT + (b = m)::INT + (c = m)::INT > 1 AS ambiguous FROM (SELECT *, least(a, b, c) AS m FROM (
  SELECT dnts, hamming(dnts, 'GT-AG') AS a, hamming(dnts, 'GC-AG') AS b, hamming(dnts, 'AT-AC') AS c FROM (SELECT DISTINCT dnts FROM s)))""")
def ambiguous_ends(spark, d):
    return _sites(spark, d).select("dnts").distinct().select("dnts", dna.ambiguous_pair(F.col("dnts")).alias("ambiguous"))


@query(f"WITH {SQL} SELECT intron_id, omitted FROM o")
def omission_tags(spark, d):
    return _omitted(spark, d).select("intron_id", "omitted")


@query(f"WITH {SQL} SELECT omitted, count(*) AS n FROM o WHERE omitted IS NOT NULL GROUP BY 1")
def omission_totals(spark, d):
    return sinks.omission_counts(_omitted(spark, d))


@query(f"WITH {SQL} SELECT dnts, count(*) AS n FROM o WHERE noncanonical AND (omitted IS NULL OR omitted NOT IN ('s', 'a')) GROUP BY 1")
def noncanonical_pairs(spark, d):
    return sinks.noncanonical_counts(_omitted(spark, d))


@query(f"WITH {SQL}, {TAGS} SELECT intron_id, duplicate FROM t")
def duplicates_by_place(spark, d):
    return tagging.tag_duplicates(_introns(spark, d)).select("intron_id", "duplicate")


@query(f"WITH {SQL}, {TAGS} SELECT intron_id, longest_isoform FROM t")
def longest_isoforms(spark, d):
    return tagging.tag_longest_isoform(_introns(spark, d)).select("intron_id", "longest_isoform")


@query(f"""WITH {SQL}, {TAGS}, k AS (SELECT * FROM t WHERE duplicate IS NULL AND omit1 IS NULL),
f AS (SELECT a.intron_id, b.intron_id AS other, row_number() OVER (PARTITION BY a.intron_id ORDER BY b.start, b.stop, b.intron_id) AS r FROM k a JOIN k b
  ON a.region = b.region AND a.strand = b.strand AND a.start <= b.stop AND a.stop >= b.start AND b.place < a.place WHERE NOT a.longest_isoform)
SELECT t.intron_id, f.other AS overlap FROM t LEFT JOIN f ON f.intron_id = t.intron_id AND f.r = 1""")
def overlap_tags(spark, d):
    tagged = tagging.tag_longest_isoform(tagging.tag_duplicates(_introns(spark, d)))
    return tagging.tag_overlaps(tagged).select("intron_id", "overlap")


@query(f"WITH {SQL}, {SCORED} SELECT intron_id, {MOTIF} AS motif, {CONTEXT} AS context FROM x WHERE omitted IS NULL OR omitted <> 's'")
def motif_text(spark, d):
    rows = _scored(spark, d).where("omitted is null or omitted <> 's'")
    motif = report.motif_string(F.substring("upstream_flank", -3, 3), F.col("five_display"), F.col("bp_seq"), F.col("bp_seq_u2"), F.col("three_display"), F.substring("downstream_flank", 1, 3))
    return rows.select("intron_id", motif.alias("motif"), report.bps_context(F.col("bp_region_seq"), F.col("bp_seq"), F.col("bp_start")).alias("context"))


@query(f"WITH {SQL}, {SCORED} SELECT {_dot('name', 'relative_score', 'dnts', MOTIF, CONTEXT, 'length', 'transcript', 'gene', 'idx', 'family_size', 'fractional_position', 'phase', 'type_id', 'defined_by')} AS value FROM x")
def meta_report(spark, d):
    return sinks.meta(_scored(spark, d))


LABEL = "name || ';' || coalesce(regexp_replace(regexp_replace(printf('%.3f', relative_score), '0+$', ''), '[.]$', '.0') || '%', '?')"


@query(f"WITH {SQL}, {SCORED} SELECT {_dot('region', 'start - 1', 'stop', LABEL, 'svm_score', 'strand')} AS value FROM x")
def bed_report(spark, d):
    return sinks.bed(_scored(spark, d))


@query(f"WITH {SQL}, {SCORED} SELECT {_dot('name', 'svm_score', 'up', 'seq', 'down')} AS value FROM x")
def sequence_report(spark, d):
    return sinks.introns_file(_scored(spark, d))


@query(f"WITH {SQL}, {SCORED} SELECT {_dot('name', 'relative_score', 'svm_score', 'relative_score', 'five_seq', 'svm_score', 'relative_score', 'bp_seq', 'bp_seq_u2', 'svm_score', 'relative_score', 'three_seq', 'svm_score', 'relative_score')} AS value FROM x WHERE svm_score IS NOT NULL")
def score_report(spark, d):
    rows = _scored(spark, d).withColumns({"score_distance": F.col("relative_score")} | {f"{r}_raw": F.col("svm_score") for r in ("five", "bp", "three")} | {f"{r}_z": F.col("relative_score") for r in ("five", "bp", "three")})
    return sinks.score_info(rows)


@query(f"WITH {SQL}, {TAGS} SELECT 'n' || duplicate || chr(9) || 'n' || intron_id AS value FROM t WHERE duplicate IS NOT NULL")
def superseded_report(spark, d):
    named = tagging.tag_duplicates(_introns(spark, d)).withColumns({"name": F.concat(F.lit("n"), F.col("intron_id").cast("string"))})
    return sinks.superseded(named, "duplicate")


@query(f"""WITH {SQL}, {SCORED} SELECT name || chr(9) || printf('%.5f (%.5f, %.5f, %.5f)', svm_score, relative_score, relative_score, relative_score) || ' --> ' || printf('%.5f (%.5f, %.5f, %.5f)', svm_score / 2, relative_score / 2, relative_score / 2, relative_score / 2) AS value
FROM x WHERE svm_score > 75""")
def demoted_report(spark, d):
    z = [f"{r}_z" for r in ("five", "bp", "three")]
    rows = _scored(spark, d).withColumns({"demoted": F.coalesce(F.col("svm_score") > 75, F.lit(False)), "was": F.struct("svm_score", *[F.col("relative_score").alias(c) for c in z])})
    return sinks.demoted(rows.withColumns({"svm_score": F.col("svm_score") / 2} | {c: F.col("relative_score") / 2 for c in z}))


@query(f"""WITH {SQL}, u AS (SELECT transcript, min(strand) AS lo, max(strand) AS hi, min(strand) FILTER (defined_by = 'cds') AS cds_lo, max(strand) FILTER (defined_by = 'cds') AS cds_hi FROM i GROUP BY 1),
v AS (SELECT i.*, CASE WHEN lo = hi THEN lo WHEN cds_lo = cds_hi THEN cds_lo END AS side FROM i JOIN u USING (transcript))
SELECT intron_id, CAST(CASE WHEN side IS NULL THEN line_number WHEN side = '-' THEN -stop ELSE start END AS BIGINT) AS k1, CAST(CASE WHEN side IS NULL THEN 0 WHEN side = '-' THEN -start ELSE stop END AS BIGINT) AS k2 FROM v""")
def coding_order(spark, d):
    leaves = _introns(spark, d).withColumnRenamed("defined_by", "feat_type")
    return hierarchy.coding_order(leaves).select("intron_id", "k1", "k2")


@query(f"""WITH {SQL}, u AS (SELECT transcript, coalesce(sum(length) FILTER (defined_by = 'cds'), sum(length)) AS n FROM i GROUP BY 1) SELECT intron_id, CAST(n AS INTEGER) AS parent_length FROM i JOIN u USING (transcript)""")
def parent_lengths(spark, d):
    leaves = _introns(spark, d).drop("parent_length").withColumnRenamed("defined_by", "feat_type")
    return hierarchy.with_lengths(leaves).select("intron_id", "parent_length")


@query("""SELECT o_orderkey AS line_number, 't' || o_custkey AS transcript, coalesce('n' || c_nationkey, CASE WHEN o_orderkey % 2 = 0 THEN 'g' || o_custkey % 50 END, 't' || o_custkey) AS gene
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) ON c_custkey = o_custkey""")
def gene_of_leaf(spark, d):
    """Leaves whose transcript has a line of its own, names a grandparent, or neither."""
    none, key, cust = F.lit(None).cast("string"), F.col("o_orderkey"), F.col("o_custkey")
    rest = [F.lit("c").alias("region"), F.lit("+").alias("strand")]
    span = [F.lit(1).alias("start"), F.lit(9).alias("stop"), F.lit(None).cast("tinyint").alias("phase")]
    exons = table(spark, d, "orders").select(key.alias("line_number"), *rest, none.alias("name"), F.lit("exon").alias("feat_type"), F.concat(F.lit("t"), cust.cast("string")).alias("parent"), F.when(key % 2 == 0, F.concat(F.lit("g"), (cust % 50).cast("string"))).alias("grandparent"), *span)
    lines = table(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("line_number"), *rest, F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("name"), F.lit("transcript").alias("feat_type"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"), none.alias("grandparent"), *span)
    return hierarchy.resolve(exons.unionByName(lines)).select("line_number", "transcript", "gene")
