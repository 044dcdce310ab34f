"""Time grids, synthetic series and timestamp ranges, generated in parallel from `range`."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds of the frequencies.
STEPS = {"hourly": 3600, "daily": 86400, "minutes": 60}
ISO = "yyyy-MM-dd'T'HH:mm:ss"


def _step(frequency: str) -> int:
    if frequency not in STEPS:
        raise ValueError(f"unsupported frequency {frequency!r}")
    return STEPS[frequency]


def grid(spark: SparkSession, start: str, end: str, frequency: str = "hourly") -> DataFrame:
    """i, ts: from start to end, both included."""
    a = F.lit(start).cast("timestamp").cast("long")
    n = spark.range(1).select(F.floor((F.lit(end).cast("timestamp").cast("long") - a) / _step(frequency)).alias("n")).first()[0]
    return spark.range(0, max(0, n + 1)).select(F.col("id").alias("i"), F.timestamp_seconds(a + F.col("id") * _step(frequency)).alias("ts"))


def values(
    spark: SparkSession,
    start: str,
    end: str,
    frequency: str = "hourly",
    series: int = 5,
    base: float = 100.0,
    trend: float = 0.0,
    noise: float = 5.0,
    daily: float | None = 10.0,
    weekly: float | None = None,
    variation: float = 0.1,
    seed: int = 0,
) -> DataFrame:
    """series_id, timestamp, value: base, trend, daily and weekly sines and noise, rounded to two digits."""
    ids = spark.range(series).select(F.format_string("series_%d", F.col("id")).alias("series_id"), F.rand(seed).alias("u1"), F.rand(seed + 1).alias("u2"))
    points = ids.crossJoin(grid(spark, start, end, frequency))  # every series has every point
    v = F.lit(base) * (1 + (F.col("u1") * 2 - 1) * variation) + F.lit(trend) * (1 + (F.col("u2") * 2 - 1) * 0.2) * F.col("i")
    if daily is not None:
        v = v + F.lit(daily) * F.sin(F.lit(2 * math.pi) * (F.hour("ts") + F.minute("ts") / 60.0) / 24.0)
    if weekly is not None:
        v = v + F.lit(weekly) * F.sin(F.lit(2 * math.pi) * F.weekday("ts") / 7.0)
    if noise:
        v = v + F.lit(noise) * F.randn(seed + 2)
    return points.select("series_id", F.date_format("ts", ISO).alias("timestamp"), F.round(v, 2).alias("value"))


def ranges(spark: SparkSession, start: str, end: str, groups: int = 20, per_group: int = 7, frequency: str = "hourly") -> DataFrame:
    """group_idx, variation_idx, timestamp: groups start evenly over the span, then go on by the frequency."""
    a, b = (F.lit(x).cast("timestamp") for x in (start, end))
    span = F.unix_micros(b) - F.unix_micros(a)
    points = spark.range(groups).select(F.col("id").alias("group_idx"), F.explode(F.sequence(F.lit(0), F.lit(per_group - 1))).alias("variation_idx"))
    at = F.unix_micros(a) + F.round(span * F.col("group_idx") / groups).cast("long") + F.col("variation_idx") * (_step(frequency) * 1_000_000)
    return points.select("group_idx", "variation_idx", F.date_format(F.timestamp_micros(at), ISO).alias("timestamp"))
