"""An index of samples by quality bucket, source, tag and status: bitmaps of sample numbers.

Each (kind, value) has a bitmap for every 32,768 sample numbers. Bitmaps are made by partial aggregates before the shuffle, kept in a
table partitioned by kind, and added to by writing those of the new samples beside the old ones: a reader takes the union.
A filter is one read of the wanted values, a union of bitmaps for each condition and an intersection of the conditions, all by
Spark's bitmap aggregates; counts need no sample. No task holds more than a bucket's bitmaps, whatever value is hot.

Sample numbers are the column `idx`, from 0, each once; rows without one are not indexed. Null values and tags have no
bitmap. An empty table has an empty index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators.query import bucket

KINDS = ("quality", "source", "tag", "status", "all")
BITS = 32_768


def build(samples: DataFrame, number: str = "idx") -> DataFrame:
    """kind, value, bucket, bits: the postings of samples."""
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    score = F.when(F.col("quality_score").isNotNull(), F.format_string("%.1f", bucket(F.col("quality_score"))))
    pairs = F.concat(
        F.array(pair("all", F.lit("")), pair("quality", score), pair("source", F.col("source_type")), pair("status", F.col("review_status"))),
        F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: pair("tag", t)),
    )
    at = F.col(number).cast("long") + 1  # bitmap functions count from 1
    rows = samples.where(F.col(number).isNotNull()).select(F.inline(pairs), F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("at"))
    return rows.where("value is not null").groupBy("kind", "value", "bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def save(samples: DataFrame, path: str, append: bool = False) -> DataFrame:
    """The index of samples, written; with append, added to the one there."""
    build(samples).write.mode("append" if append else "errorifexists").partitionBy("kind").parquet(path)
    return load(samples.sparkSession, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("value string, bucket long, bits binary, kind string").parquet(path)


def _conditions(quality, source_types, tags, tag_mode, statuses) -> list[Column]:
    """The postings that meet each condition; an empty list is no condition."""
    kind, value = F.col("kind"), F.col("value")
    low, high = quality
    out = []
    if low is not None or high is not None:
        q = value.cast("double")
        inside = (q >= low if low is not None else F.lit(True)) & (q <= high if high is not None else F.lit(True))
        out.append((kind == "quality") & inside)
    if source_types:
        out.append((kind == "source") & value.isin(source_types))
    if tags and tag_mode not in ("any", "all"):
        raise ValueError(f"unknown mode {tag_mode!r}")
    if tags and tag_mode == "any":
        out.append((kind == "tag") & value.isin(tags))
    if tags and tag_mode == "all":
        out += [(kind == "tag") & (value == t) for t in dict.fromkeys(tags)]
    if statuses:
        out.append((kind == "status") & value.isin(statuses))
    return out or [kind == "all"]


def matching(
    index: DataFrame,
    quality: tuple[float | None, float | None] = (None, None),
    source_types: list[str] | None = None,
    tags: list[str] | None = None,
    tag_mode: str = "any",
    statuses: list[str] | None = None,
) -> DataFrame:
    """bucket, bits: the samples that meet all conditions."""
    met = _conditions(quality, source_types, tags, tag_mode, statuses)
    wanted = met[0]
    for c in met[1:]:
        wanted = wanted | c
    each = F.explode(F.filter(F.array(*(F.when(c, k) for k, c in enumerate(met))), lambda k: k.isNotNull())).alias("condition")
    of_each = index.where(wanted).select("bucket", "bits", each).groupBy("bucket", "condition").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = of_each.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    return both.where(F.col("n") == len(met)).select("bucket", "bits").where(F.bitmap_count("bits") > 0)


def count(matches: DataFrame) -> DataFrame:
    """n: how many samples match."""
    return matches.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def numbers(matches: DataFrame) -> DataFrame:
    """idx: the numbers of the samples that match."""
    pairs = F.posexplode(F.regexp_extract_all(F.hex("bits"), F.lit(".."), F.lit(0)))
    bytes_ = matches.select("bucket", pairs.alias("byte", "pair")).where("pair != '00'").select("bucket", "byte", F.conv("pair", 16, 10).cast("int").alias("set"))
    bits = bytes_.select("bucket", "byte", "set", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")).where(F.getbit("set", F.col("bit")) == 1)
    return bits.select(((F.col("bucket") - 1) * BITS + F.col("byte") * 8 + F.col("bit")).alias("idx"))


def select(samples: DataFrame, matches: DataFrame, number: str = "idx") -> DataFrame:
    """The samples that match, by their bucket's bitmap: a bucket has no more than its 32,768 numbers."""
    at = F.col(number).cast("long")
    m = matches.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", (F.pmod(at, F.lit(BITS)) / 8 + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = samples.join(m, F.bitmap_bucket_number(at + 1) == F.col("__bucket"))
    return held.where(F.getbit(byte, F.pmod(at, F.lit(8))) == 1).select(*samples.columns)


def distributions(index: DataFrame) -> DataFrame:
    """kind, value, n: samples of each value, without reading a sample."""
    whole = index.where("kind != 'all'").groupBy("kind", "value", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return whole.groupBy("kind", "value").agg(F.sum(F.bitmap_count("bits")).alias("n"))
