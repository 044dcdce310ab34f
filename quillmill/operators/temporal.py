"""Validation and statistics of temporal facts: rows, groups and the whole set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import strip

LEAST, MOST = 20, 1200


def row_errors(least: int = LEAST, most: int = MOST) -> Column:
    """Errors of a fact: text, timestamp, group, variation number."""
    fact, size = F.coalesce("fact", F.lit("")), F.length("fact").cast("string")
    lead = F.concat(F.lit("Sample "), F.col("idx").cast("string"), F.lit(": "))
    text = (
        F.when(strip(fact) == "", F.lit("Missing or empty fact text (instruction)"))
        .when(F.length(fact) < least, F.concat(F.lit("Fact too short ("), size, F.lit(f" chars, min {least})")))
        .when(F.length(fact) > most, F.concat(F.lit("Fact too long ("), size, F.lit(f" chars, max {most})")))
    )
    ts = F.col("timestamp")
    when = F.when(ts.isNull() | (ts == ""), F.lit("Missing timestamp in metadata")).when(
        F.try_to_timestamp(ts).isNull(), F.concat(F.lit("Invalid timestamp format: "), ts)
    )
    group = F.when(F.col("group_id").isNull() | (F.col("group_id") == ""), F.lit("Missing group_id in metadata"))
    v = F.col("variation_id")
    number = F.when(v.isNull(), F.lit("Missing variation_id in metadata")).when(v < 1, F.concat(F.lit("Invalid variation_id: "), v.cast("string")))
    return F.transform(F.filter(F.array(text, when, group, number), lambda x: x.isNotNull()), lambda x: F.concat(lead, x))


#: List numbers that a piece of a group spans: at most so many rows of a group are sorted together.
PIECE = 100_000


def _order(facts: DataFrame, piece: int) -> DataFrame:
    """group_id, read (times that can be), falls: how often the time falls in list order.

    A group's rows are cut at multiples of `piece` list numbers. A piece is summed up by its first and last time and the falls
    within; pieces, one row each, are put together at their borders."""
    ts = F.try_to_timestamp("timestamp")
    rows = facts.select("group_id", "idx", ts.alias("t"), F.floor(F.col("idx") / piece).alias("piece"))
    before = F.lag("t").over(Window.partitionBy("group_id", "piece").orderBy("idx"))
    rows = rows.withColumn("fell", F.col("t") < before)
    pieces = rows.groupBy("group_id", "piece").agg(
        F.count("t").alias("read"), F.count_if("fell").alias("falls"), F.min_by("t", "idx").alias("first"), F.max_by("t", "idx").alias("last")
    )
    border = F.col("first") < F.lag("last").over(Window.partitionBy("group_id").orderBy("piece"))
    return pieces.withColumn("fell", border).groupBy("group_id").agg(F.sum("read").alias("read"), (F.sum("falls") + F.count_if("fell")).alias("falls"))


def groups(facts: DataFrame, evolution: bool = False, piece: int = PIECE) -> DataFrame:
    """group_id, n, sequential, duplicate_facts, chronological.

    Numbers are sequential if they are 1..n; facts are duplicates if equal without case and outer white space; times must
    not fall in list order, and are only judged where all can be read. Nothing of a group is gathered, and no task takes a
    group whole: counts combine before the shuffle, distinct numbers and facts are spread, and times are judged by pieces (see
    `_order`). List numbers, `idx`, differ within a group. A null group is one of its own."""
    low = F.lower(strip(F.coalesce("fact", F.lit(""))))
    same = facts.groupBy("group_id", F.sha2(low, 256).alias("f")).agg(F.count(F.lit(1)).alias("k"))
    same = same.groupBy("group_id").agg(F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("duplicate_facts"))
    numbers = facts.groupBy("group_id", "variation_id").agg(F.count(F.lit(1)).alias("k"))
    numbers = numbers.groupBy("group_id").agg(
        F.sum("k").alias("n"), F.sum(F.when(F.col("variation_id").isNotNull(), F.col("k")).otherwise(0)).alias("given"), F.count("variation_id").alias("distinct"), F.min("variation_id").alias("low"), F.max("variation_id").alias("high")
    )
    out = numbers
    for part in (_order(facts, piece), same):  # one row a group each
        part = part.withColumnRenamed("group_id", "__group")
        out = out.join(part, out["group_id"].eqNullSafe(part["__group"])).drop("__group")
    return out.select(
        "group_id",
        "n",
        ((F.col("given") == F.col("n")) & (F.col("distinct") == F.col("n")) & (F.col("low") == 1) & (F.col("high") == F.col("n"))).alias("sequential"),
        (F.lit(0).cast("long") if evolution else F.col("duplicate_facts")).alias("duplicate_facts"),
        ((F.col("read") < F.col("n")) | (F.col("falls") == 0)).alias("chronological"),
    )


def summary(facts: DataFrame, evolution: bool = False) -> DataFrame:
    """total, valid, n_errors, group_count, n_warnings."""
    rows = facts.withColumn("e", row_errors()).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.size("e") == 0).alias("valid"), F.coalesce(F.sum(F.size("e")), F.lit(0)).alias("n_errors")
    )
    warned = (~F.col("sequential")).cast("int") + (F.col("duplicate_facts") > 0).cast("int") + (~F.col("chronological")).cast("int")
    per = groups(facts, evolution).agg(F.count(F.lit(1)).alias("group_count"), F.coalesce(F.sum(warned), F.lit(0)).alias("n_warnings"))
    return rows.crossJoin(per)  # one row each


def statistics(facts: DataFrame) -> DataFrame:
    """total_facts, num_groups, avg_facts_per_group, start_date, end_date, days, detected_frequency."""
    ts = F.try_to_timestamp("timestamp")
    first = facts.select("idx", ts.alias("t")).where("t is not null").orderBy("idx").limit(11)  # what the frequency is read from
    step = first.select(((F.lead("t").over(Window.orderBy("idx")).cast("double") - F.col("t").cast("double")) / 3600).alias("h")).agg(F.avg("h").alias("h"))
    h = F.col("h")
    frequency = (
        F.when(h.between(0.9, 1.1), "hourly").when(h.between(23, 25), "daily").when(h.between(0.015, 0.025), "minutes").otherwise(F.concat(F.lit("~"), F.format_string("%.1f", h), F.lit(" hours")))
    )
    all_ = facts.agg(
        F.count(F.lit(1)).alias("total_facts"), F.countDistinct(F.nullif("group_id", F.lit(""))).alias("num_groups"), F.count(F.nullif("group_id", F.lit(""))).alias("grouped"), F.min(ts).alias("a"), F.max(ts).alias("b")
    )
    return all_.crossJoin(step).select(  # one row each
        "total_facts",
        "num_groups",
        F.round(F.col("grouped") / F.col("num_groups"), 1).alias("avg_facts_per_group"),
        F.date_format("a", "yyyy-MM-dd'T'HH:mm:ss").alias("start_date"),
        F.date_format("b", "yyyy-MM-dd'T'HH:mm:ss").alias("end_date"),
        F.floor((F.col("b").cast("double") - F.col("a").cast("double")) / 86400).cast("long").alias("days"),
        F.when(h.isNotNull(), frequency).alias("detected_frequency"),
    )
