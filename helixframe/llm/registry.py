"""What __spark_entry__.py adds: the queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from helixframe.llm import contracts, oracles


def queries() -> dict:
    return {k: f for k, f in vars(contracts).items() if k.startswith("op") and callable(f)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {k: v for k, v in oracles.ORACLES.items() if k in queries()}
