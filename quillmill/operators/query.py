"""Filters, search and summary statistics over samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(q: Column) -> Column:
    """q rounded to one digit as Python rounds: half cases fall as the double nearest to k.k5 does."""

    def of(x: Column) -> Column:
        out = F.when(x.isNotNull(), F.lit(0.0))
        for k in range(10):
            half = float(f"0.{k}5")
            out = F.when((x >= half) if round(half, 1) > half else (x > half), F.lit((k + 1) / 10)).otherwise(out)
        return out

    return F.transform(F.array(q), of)[0]  # q may be a long expression: compute it once


def in_quality(low: float | None = None, high: float | None = None, mode: str = "bucket", column: str = "quality_score") -> Column:
    """Range of quality: of the rounded value (`bucket`) or the value itself (`exact`); null never passes a bound."""
    if mode not in ("bucket", "exact"):
        raise ValueError(f"unknown mode {mode!r}")
    if low is None and high is None:
        return F.lit(True)
    q = bucket(F.col(column)) if mode == "bucket" else F.col(column)
    ok = F.col(column).isNotNull()
    ok = ok & (q >= low) if low is not None else ok
    return ok & (q <= high) if high is not None else ok


def has_tags(tags: list[str], mode: str = "any") -> Column:
    wanted = F.array(*map(F.lit, tags))
    if mode == "any":
        return F.arrays_overlap("tags", wanted)
    if mode == "all":
        return F.size(F.array_except(wanted, "tags")) == 0
    raise ValueError(f"unknown mode {mode!r}")


def select(
    samples: DataFrame,
    quality: tuple[float | None, float | None] = (None, None),
    source_types: list[str] | None = None,
    tags: list[str] | None = None,
    tag_mode: str = "any",
    statuses: list[str] | None = None,
    mode: str = "bucket",
) -> DataFrame:
    """The samples that meet all given conditions; an empty list is none."""
    keep = in_quality(*quality, mode=mode)
    if source_types:
        keep = keep & F.col("source_type").isin(source_types)
    if tags:
        keep = keep & has_tags(tags, tag_mode)
    if statuses:
        keep = keep & F.col("review_status").isin(statuses)
    return samples.where(keep)


def find_by_id(samples: DataFrame, wanted, column: str = "id") -> DataFrame:
    return samples.where(F.col(column) == wanted).orderBy("idx").limit(1)


def find_by_text(samples: DataFrame, needle: str, fields: tuple[str, ...] = ("instruction", "response"), case_sensitive: bool = False) -> DataFrame:
    found = F.lit(False)
    for f in fields:
        c = F.coalesce(F.col(f), F.lit(""))
        found = found | (F.contains(c, F.lit(needle)) if case_sensitive else F.contains(F.lower(c), F.lower(F.lit(needle))))
    return samples.where(found)


def distributions(samples: DataFrame) -> DataFrame:
    """kind, value, n: counts by quality bucket, source, tag and status, in one pass."""
    score = F.when(F.col("quality_score").isNotNull(), F.format_string("%.1f", bucket(F.col("quality_score"))))
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    pairs = F.concat(
        F.array(pair("quality", score), pair("source", F.col("source_type")), pair("status", F.col("review_status"))),
        F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: pair("tag", t)),
    )
    return samples.select(F.inline(pairs)).where("value is not null").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def store_metadata(samples: DataFrame) -> DataFrame:
    """n, n_scored, mean, std, min, max of the quality scores."""
    q = F.col("quality_score")
    return samples.agg(
        F.count(F.lit(1)).alias("n"), F.count(q).alias("n_scored"), F.avg(q).alias("mean"), F.stddev_pop(q).alias("std"), F.min(q).alias("min"), F.max(q).alias("max")
    )


def review_stats(samples: DataFrame) -> DataFrame:
    """Counts by review outcome, everything undecided as pending; the mean leaves out zero scores."""
    status = F.col("review_status")
    return samples.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "approved").alias("approved"),
        F.count_if(status == "rejected").alias("rejected"),
        F.count_if(~F.coalesce(status.isin("approved", "rejected"), F.lit(False))).alias("pending"),
        F.avg(F.nullif(F.col("quality_score"), F.lit(0.0))).alias("mean_quality"),
    )


def score_summary(samples: DataFrame, column: str = "quality_score") -> DataFrame:
    q = F.nullif(F.col(column), F.lit(0.0))
    return samples.agg(F.avg(q).alias("mean"), F.stddev_pop(q).alias("std"), F.min(q).alias("min"), F.max(q).alias("max"))


def preview(samples: DataFrame, status: str | None = None, width: int = 80) -> DataFrame:
    """idx, instruction, response, quality, status, tags: a table's short forms, in order; statuses that contain `status`."""
    short = lambda c: F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(F.coalesce(F.col(c), F.lit(""))).alias(c)
    rows = samples if status is None else samples.where(F.contains(F.col("review_status"), F.lit(status)))
    score = F.when(F.col("quality_score").isNull(), "N/A").otherwise(F.format_string("%.2f", "quality_score"))
    tags = F.array_join(F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 3), ", ")
    return rows.orderBy("idx").select("idx", short("instruction"), short("response"), score.alias("quality"), F.col("review_status").alias("status"), tags.alias("tags"))
