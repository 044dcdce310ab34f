"""Streams of sample files through validation and scoring, without state; for exact dedup of streams see the docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillmill.operators import score, validate


def curated(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """A streaming DataFrame of the valid samples that arrive in a folder of Parquet files, with their scores."""
    return score.score(validate.valid_only(spark.readStream.schema(schema).parquet(folder)))


def run_once(samples: DataFrame, out: str, checkpoint: str) -> None:
    """Take all that has arrived, append it as Parquet and stop."""
    query = samples.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
