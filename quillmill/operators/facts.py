"""Groups of dated facts written by a model: variations of one fact, with a reviewer, or the events of a story.

Every group is a row, every call of the model a stage over all groups, and stages are written before they are used
again. A group whose first stage comes back empty is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.text import strip
from quillmill.operators import series
from quillmill.operators.generate import TextGenerator, clean_fact, cut_event, fallback_variations, generated, parse_variations, verdict
from quillmill.plans.scratch import scratch, written

#: Domains of facts; words of outline lines that aren't events; the event that fills up a short outline; what
#: a line of an outline is told with, if the model gives nothing.
DOMAINS = ["news", "science", "business", "sports", "social", "entertainment", "technology"]
#: What a model is told of each domain.
GUIDANCE = {
    "news": "an event of public interest, with place, date and counts",
    "science": "a finding with what was measured, by how much and on how many cases",
    "business": "a company's result or deal, with amounts and the change in per cent",
    "sports": "a match or record, with the score or time and who set it",
    "social": "a change in how people live, with the share of people and the years compared",
    "entertainment": "a release or award, with sales, viewers or ratings",
    "technology": "a product or system, with a measured speed, size or price",
}
OUTLINE_WORDS = ["example", "requirement", "write", "event:", "bullet"]
FILLER = "Additional developments continued in the ongoing situation."
AFTERWARDS, SHORT = "Following the previous developments, ", "At this stage of the unfolding events, "

Make = Callable[[], TextGenerator]


def _kept(df: DataFrame, tag: str) -> DataFrame:
    return written(df, scratch(df.sparkSession, tag))


def _numbered(facts: Column) -> Column:
    """The facts as a numbered list."""
    return F.array_join(F.transform(facts, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def reviewed(groups: DataFrame, make: Make, **how) -> DataFrame:
    """group_idx, seed, facts, status (passed, corrected or unread), corrections.

    A reviewer's verdict names facts that repeat others or change the seed's figures; each is written anew, and stays as
    it was where the model gives nothing usable. Indices outside of the group are ignored."""
    ask = F.concat(F.lit("Review the statements against the fact. Answer in JSON with all_consistent, duplicate_indices, inconsistent_indices (from 0) and issues_description.\nFact: "), "seed", F.lit("\n"), _numbered(F.col("facts")))
    rows = generated(groups.select("group_idx", "seed", "facts", ask.alias("prompt")), make, **how).withColumn("v", verdict(F.col("answer")))
    rows = _kept(rows.drop("prompt", "answer"), "review")
    none = F.array().cast("array<int>")
    named = F.array_union(F.coalesce("v.duplicate_indices", none), F.coalesce("v.inconsistent_indices", none))
    bad = F.filter(named, lambda i: (i >= 0) & (i < F.size("facts")))
    rows = rows.withColumn("bad", F.when(F.coalesce("v.all_consistent", F.lit(False)) | F.col("v").isNull(), none).otherwise(bad))
    one = rows.select("group_idx", "seed", "facts", "v.duplicate_indices", F.explode("bad").alias("i")).withColumn("old", F.col("facts")[F.col("i")])
    issue = F.when(F.array_contains("duplicate_indices", F.col("i")), "it is too similar to others").otherwise("its figures differ from the fact's")
    others = F.array_join(F.filter("facts", lambda x: x != F.col("old")), "\n- ")
    ask = F.concat(F.lit("Rewrite the statement, as "), issue, F.lit(".\nFact: "), "seed", F.lit("\nStatement: "), "old", F.lit("\nOthers:\n- "), others)
    one = generated(one.select("group_idx", "i", ask.alias("prompt")), make, **how)
    new = strip(F.col("answer"))
    new = F.when(F.contains(new, F.lit(":")), strip(F.regexp_replace(new, r"(?s)\A[^:]*:", ""))).otherwise(new)
    new = F.regexp_replace(new, r"""\A["']+|["']+\z""", "")
    fixed = one.select("group_idx", "i", new.alias("new")).where(F.length("new") > 15)
    fixed = fixed.groupBy("group_idx").agg(F.map_from_entries(F.collect_list(F.struct("i", "new"))).alias("fixed"))  # as many as a group's facts at most
    out = rows.join(fixed, "group_idx", "left")
    status = F.when(F.col("v").isNull(), "unread").when(F.col("v.all_consistent"), "passed").otherwise("corrected")
    return out.select(
        "group_idx",
        "seed",
        F.when(F.col("fixed").isNull(), F.col("facts")).otherwise(F.transform("facts", lambda x, i: F.coalesce(F.try_element_at("fixed", i), x))).alias("facts"),
        status.alias("status"),
        F.coalesce(F.size("fixed"), F.lit(0)).alias("corrections"),
    )


def variations(spark: SparkSession, make: Make, groups: int = 20, per_group: int = 7, domain: str = "news", review: bool = True, **how) -> DataFrame:
    """group_idx, facts: variations of one fact a group, filled up with it."""
    if domain not in DOMAINS:
        raise ValueError(f"unknown domain {domain!r}")
    ask = F.concat(F.lit(f"Write one {domain} fact with figures: {GUIDANCE[domain]}. Number "), (F.col("id") + 1).cast("string"))
    rows = generated(spark.range(groups).select(F.col("id").alias("group_idx"), ask.alias("prompt")), make, **how)
    rows = rows.select("group_idx", clean_fact(F.col("answer")).alias("seed")).where("seed is not null")
    rows = rows.withColumn("prompt", F.concat(F.lit(f"Say this in {per_group} other ways, one a line, with the same figures: "), "seed"))
    found = parse_variations(F.col("answer"), F.col("seed"))
    rows = generated(rows, make, **how)
    facts = F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(fallback_variations(F.col("seed"), per_group))
    facts = F.slice(F.concat(facts, F.array_repeat("seed", per_group)), 1, per_group)
    rows = _kept(rows.select("group_idx", "seed", facts.alias("facts")), "variations")
    return (reviewed(rows, make, **how) if review else rows).select("group_idx", "facts")


def outline(text: Column) -> Column:
    """The usable lines of an outline: without numbers and bullets, of 30 to 150 characters."""

    def bare(line: Column) -> Column:
        return (
            F.when(line.rlike(r"\A\p{Nd}"), F.when(F.contains(line, F.lit(".")), strip(F.regexp_replace(line, r"\A[^.]*\.", ""))).otherwise(F.lit("")))
            .when(line.rlike(r"\A[-*]"), strip(F.substring(line, 2, 1 << 30)))
            .otherwise(line)
        )

    def usable(line: Column) -> Column:
        keep = F.length(line).between(30, 150)
        for w in OUTLINE_WORDS:
            keep = keep & ~F.contains(F.lower(line), F.lit(w))
        return keep

    return F.filter(F.transform(F.split(strip(text), "\n"), lambda x: bare(strip(x))), usable)


def clean_event(text: Column) -> Column:
    """An expanded event without a label, number or quotes."""
    e = strip(text)
    e = F.when(e.rlike(r"(?si)\A[^:]{0,39}:") & F.lower(F.substring_index(e, ":", 1)).rlike("expanded|event"), strip(F.regexp_replace(e, r"(?s)\A[^:]*:", ""))).otherwise(e)
    e = F.regexp_replace(e, r"\A\p{Nd}[.)] ", "")
    return F.regexp_replace(strip(e), r"""\A["']+|["']+\z""", "")


def stories(spark: SparkSession, make: Make, groups: int = 20, per_group: int = 7, domain: str = "news", most: int = 1100, **how) -> DataFrame:
    """group_idx, facts: an outline of events a group, each told with the two before it in view.

    Outlines of less than 60 % of the events are no outlines. An event without a usable answer is its outline's line."""
    if domain not in DOMAINS:
        raise ValueError(f"unknown domain {domain!r}")
    ask = F.concat(F.lit(f"Outline a {domain} story, on {GUIDANCE[domain]}, in {per_group} connected events, one a line. Number "), (F.col("id") + 1).cast("string"))
    rows = generated(spark.range(groups).select(F.col("id").alias("group_idx"), ask.alias("prompt")), make, **how)
    rows = rows.select("group_idx", outline(F.col("answer")).alias("lines")).where(F.size("lines") >= max(1, 0.6 * per_group))
    lines = F.slice(F.concat("lines", F.array_repeat(F.lit(FILLER), per_group)), 1, per_group)
    rows = _kept(rows.select("group_idx", lines.alias("lines"), F.array().cast("array<string>").alias("facts")), "outlines")
    for k in range(per_group):
        line = F.col("lines")[k]
        before = F.array_join(F.transform(F.slice("facts", F.lit(max(1, k - 1)), F.lit(2)), lambda x: F.substring(x, 1, 100)), "\n- ")
        ask = F.concat(F.lit("Tell this event in full: "), line, F.lit("\nBefore it:\n- "), before)
        plain = line if k == 0 else F.concat(F.lit(AFTERWARDS), F.lower(line))
        plain = F.when(F.length(plain) < 50, F.concat(F.lit(SHORT), plain)).otherwise(plain)
        rows = generated(rows.withColumn("prompt", ask), make, **how)
        told = F.coalesce(cut_event(clean_event(F.col("answer")), most), plain)
        rows = rows.select("group_idx", "lines", F.concat("facts", F.array(told)).alias("facts"))
    return _kept(rows, "stories").select("group_idx", "facts")


def dated(groups: DataFrame, n: int, start: str = "2024-01-01", end: str = "2024-01-31", per_group: int = 7, frequency: str = "hourly") -> DataFrame:
    """idx, timestamp, fact, group_id, variation_id: the facts of n groups at the times of `series.ranges`."""
    times = series.ranges(groups.sparkSession, start, end, n, per_group, frequency)
    rows = groups.select("group_idx", F.posexplode("facts").alias("variation_idx", "fact")).join(times, ["group_idx", "variation_idx"])
    return rows.select(
        (F.col("group_idx") * per_group + F.col("variation_idx")).alias("idx"),
        "timestamp",
        strip(F.col("fact")).alias("fact"),
        F.format_string("group_%03d", F.col("group_idx") + 1).alias("group_id"),
        (F.col("variation_idx") + 1).alias("variation_id"),
    )


def to_samples(facts: DataFrame, evolution: bool = False) -> DataFrame:
    """Facts as samples with empty responses; group, time and number in tags and custom metadata."""
    kind = "evolution" if evolution else "variation"
    custom = F.to_json(F.struct("timestamp", "group_id", "variation_id", F.lit(evolution).alias("evolution_mode")))
    return facts.select(
        "idx",
        F.col("fact").alias("instruction"),
        F.lit("").alias("response"),
        F.lit("generated_temporal_facts").alias("source_type"),
        F.lit(None).cast("double").alias("quality_score"),
        F.lit("pending").alias("review_status"),
        F.array(F.lit("temporal"), F.lit("embedding-experiment"), F.lit(kind), F.col("group_id")).alias("tags"),
        custom.alias("custom_json"),
    )


def span(facts: DataFrame) -> DataFrame:
    """n, first, last, days (whole), groups."""
    t = F.try_to_timestamp("timestamp")
    days = F.floor((F.max(t).cast("long") - F.min(t).cast("long")) / 86400)
    return facts.agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), days.alias("days"), F.countDistinct("group_id").alias("groups"))
