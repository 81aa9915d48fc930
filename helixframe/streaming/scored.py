"""An extension: intron sequences scored as they arrive, with a frozen model. The reference has no streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.config import Config
from helixframe.operators import scoring, sequences, svm

SCHEMA = "intron_id long, ts timestamp, upstream_flank string, seq string, downstream_flank string"


def source(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of introns, as they appear in a folder."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def scored(introns: DataFrame, pwms: DataFrame, models: Sequence[svm.Model], scale: dict[str, tuple[float, float]], config: Config, late: str = "10 minutes") -> DataFrame:
    """Stateless but for dropping repeats of an intron_id within the watermark. scale: region -> (mean, deviation)."""
    fresh = introns.withWatermark("ts", late).dropDuplicatesWithinWatermark(["intron_id"])
    raw = scoring.score(sequences.assign(fresh, config), pwms, config)
    z = {f"{r}_z": (F.col(f"{r}_raw") - m) / (s or 1.0) for r, (m, s) in scale.items()}
    return svm.predict(raw.withColumns(z), models, list(z), config.threshold)
