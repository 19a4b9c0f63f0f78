"""Scores of responses as they arrive (an extension).

Parsing and scoring are row-wise, so the batch operators run unchanged on a
stream; windows with a watermark give running means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluators import score_anih


def read_responses(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_scores(responses: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean hit and composite of each window of event time ``ts`` and model."""
    scored = score_anih(responses).withWatermark("ts", late)
    return scored.groupBy(F.window("ts", window), "model").agg(F.count(F.lit(1)).alias("n"), F.avg("timestamp_hit_5s").alias("hit_5s"), F.avg("composite_score").alias("composite"))
