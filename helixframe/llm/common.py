"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; only where that is unset in a local session
    (tests) one of our own: executors elsewhere couldn't read it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "helixframe-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives the loss of any executor.

    The tables of one application lie in one folder and can be removed once it has ended. Shuffle files of the steps
    that led here are let go of at once, not at the driver's next garbage collection, so disk holds one step's.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/helixframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def merged(small: DataFrame) -> DataFrame:
    """One side of a join that is never broadcast, at any size: it grows with the data."""
    return small.hint("merge")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def keep_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Only the named columns, so that further ones can't clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def by_bytes(batches, limit: int = 4 << 20, column: str = "text"):
    """Slices of Arrow batches with about limit bytes of text each, so that long texts don't add up."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
