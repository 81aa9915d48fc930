"""From raw documents to packed training sequences: five stages, each written as a table and read by the next.

Defined results: rows with null or empty text are rejected by the quality rules, so nothing later sees them; rows without
a doc_id pass like others, those without a source are a source of their own; of repeated rows one stays; ties are broken
by doc_id, then text; an empty table gives no piece; further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import mixing, near_dedup, packing, quality, secret_scan
from helixframe.llm.common import settle, table
from helixframe.llm.contracts import vocab


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    return near_dedup.keep_first(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by a mark."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The curriculum's stream: documents as often as their source's target asks, in training order."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4,096 tokens, with their ids."""
    return packing.pack(docs, vocab("word_bpe_49k.json"))


STAGES = [("quality", good), ("near_dedup", distinct), ("secrets", without_secrets), ("mixing", mixed), ("packing", packed)]

#: The last stages have no SQL: tokenization and packing are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
