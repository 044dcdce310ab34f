"""Heuristic quality scores of instruction/response samples: six components and their weighted mean.

Null texts count as empty; text of white space only counts as not punctuated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import WORD, WS, any_in, blank, count_in, is_upper, starts_any, strip, words
from quillmill.plans.scratch import scratch, written

#: Vocabularies of the rules.
QUESTION_WORDS = ["what", "when", "where", "who", "why", "how", "which"]
VAGUE_WORDS = ["something", "anything", "somehow", "whatever", "stuff", "things"]
CLAUSE_MARKS = [",", ";", ":", "because", "therefore", "however"]
LIST_MARKS = ["1.", "2.", "-", "*"]
CONCLUSIONS = ["therefore", "thus", "in conclusion", "summary", "finally"]
TRANSITIONS = ["first", "second", "next", "then", "finally", "however", "therefore", "thus", "additionally", "furthermore", "moreover", "consequently"]
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for"]
WEIGHTS = {
    "instruction_clarity": 0.20,
    "instruction_complexity": 0.15,
    "response_completeness": 0.25,
    "response_coherence": 0.20,
    "alignment": 0.15,
    "diversity": 0.05,
}


def _if(cond: Column, value: float) -> Column:
    return F.when(cond, F.lit(value)).otherwise(F.lit(0.0))


def _times(cond: Column, value: float) -> Column:
    return F.when(cond, F.lit(value)).otherwise(F.lit(1.0))


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def clarity(i: Column, low: Column) -> Column:
    size = F.length(i)
    s = F.when(size < 20, F.lit(0.5)).when(size > 1000, F.lit(0.8)).otherwise(F.lit(1.0))
    s = s * _times(~strip(i).rlike(r"[.!?]\z"), 0.9) * _times(is_upper(i), 0.7)
    s = s * _times(starts_any(low, QUESTION_WORDS) & ~F.contains(i, F.lit("?")), 0.9) * _times(count_in(low, VAGUE_WORDS) > 2, 0.8)
    return F.when(blank(i), F.lit(0.0)).otherwise(_clamp(s))


def complexity(i: Column, w: Column, lower: Column) -> Column:
    n = F.size(w)
    of = F.greatest(n, F.lit(1)).cast("double")
    distinct = F.size(F.array_distinct(lower)).cast("double")
    letters = F.length(F.array_join(w, "")).cast("double")
    s = F.lit(0.5) + _if(n > 10, 0.1) + _if(n > 20, 0.1) + _if(distinct / of > 0.7, 0.1) + _if(letters / of > 5, 0.1) + _if(letters / of > 7, 0.1)
    return F.when(blank(i), F.lit(0.0)).otherwise(_clamp(s + _if(count_in(i, CLAUSE_MARKS) > 2, 0.1)))


def completeness(i: Column, r: Column, lr: Column, wi: Column, wr: Column) -> Column:
    ratio = F.size(wr).cast("double") / F.greatest(F.size(wi), F.lit(1)).cast("double")
    s = F.lit(0.5) + _if(ratio >= 1, 0.2) + _if(ratio >= 2, 0.1) + _if(F.contains(r, F.lit("\n\n")), 0.1)
    s = s + _if(any_in(r, LIST_MARKS), 0.05) + _if(any_in(r, ["```", "    "]), 0.05) + _if(any_in(lr, CONCLUSIONS), 0.1)
    return F.when(blank(i) | blank(r), F.lit(0.0)).otherwise(_clamp(s))


def coherence(r: Column, lr: Column, wl: Column) -> Column:
    """wl: the lower-cased words of the response."""
    found, parts = count_in(lr, TRANSITIONS), F.split(r, r"\.")
    capital = F.size(F.filter(parts, lambda p: p.rlike(rf"\A{WS}*\p{{Lu}}"))).cast("double")
    unique = F.size(F.array_distinct(wl)).cast("double") / F.size(wl).cast("double")
    s = F.lit(0.6) + _if(found >= 2, 0.1) + _if(found >= 4, 0.1)
    s = s + _if((F.size(parts) > 1) & (capital / F.size(parts).cast("double") > 0.8), 0.1)
    return F.when(blank(r), F.lit(0.0)).otherwise(_clamp(s - _if((F.size(wl) > 10) & (unique < 0.5), 0.2)))


def alignment(i: Column, r: Column) -> Column:
    """Both texts lower-cased."""
    keys = F.array_except(F.array_distinct(F.regexp_extract_all(i, F.lit(f"({WORD})"), 1)), F.array(*map(F.lit, STOP_WORDS)))
    overlap = F.size(F.filter(keys, lambda k: F.contains(r, k))).cast("double") / F.size(keys).cast("double")
    s = F.lit(0.5) + F.when(F.size(keys) > 0, overlap * 0.4).otherwise(F.lit(0.0))
    s = s + _if(F.contains(i, F.lit("write")) & F.contains(i, F.lit("code")) & any_in(r, ["def ", "function", "```"]), 0.1)
    s = s + _if(F.contains(i, F.lit("explain")) & any_in(r, ["because", "reason"]), 0.1)
    s = s + _if(any_in(i, ["list", "steps"]) & any_in(r, ["1.", "2.", "3.", "-", "*"]), 0.1)
    return F.when(blank(i) | blank(r), F.lit(0.0)).otherwise(_clamp(s))


def diversity(w: Column) -> Column:
    """w: the lower-cased words of both texts."""
    ratio = F.size(F.array_distinct(w)).cast("double") / F.size(w).cast("double")
    return F.when(F.size(w) < 10, F.lit(0.5)).when(ratio < 0.4, F.lit(0.3)).otherwise(F.least(F.lit(1.0), ratio * 1.5))


def overall(weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the component columns; components without a weight don't count."""
    weights = weights or WEIGHTS
    total, norm = F.lit(0.0), 0.0
    for name in WEIGHTS:
        total, norm = total + F.col(name) * F.lit(float(weights.get(name, 0.0))), norm + weights.get(name, 0.0)
    return total / F.lit(norm) if norm else F.lit(0.0)


def score(samples: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The samples with the six components and `overall`."""
    # shared parts are columns of their own, so that no component computes them again
    held = samples.withColumns({"__i": F.coalesce("instruction", F.lit("")), "__r": F.coalesce("response", F.lit(""))})
    held = held.withColumns({"__li": F.lower("__i"), "__lr": F.lower("__r"), "__wi": words(F.col("__i"))})
    held = held.withColumns({"__wl": words(F.col("__lr")), "__wli": F.transform("__wi", F.lower)})
    i, r, li, lr, wi, wl, wli = (F.col(c) for c in ("__i", "__r", "__li", "__lr", "__wi", "__wl", "__wli"))
    held = held.withColumns(
        {
            "instruction_clarity": clarity(i, li),
            "instruction_complexity": complexity(i, wi, wli),
            "response_completeness": completeness(i, r, lr, wi, wl),
            "response_coherence": coherence(r, lr, wl),
            "alignment": alignment(li, lr),
            "diversity": diversity(F.concat(wli, wl)),
        }
    )
    return held.withColumn("overall", overall(weights)).drop("__i", "__r", "__li", "__lr", "__wi", "__wl", "__wli")


#: Bins of a pass of `median`, and the size of a sketch: at k = 4096 its ranks are off by less than 0.2 % of the rows.
BINS, SKETCH, RANK_ERROR = 1024, 4096, 0.002


def median(values: DataFrame, column: str) -> float | None:
    """The exact median, by narrowing the range that holds it: a pass counts `BINS` bins, and no task holds the values.

    `values` is read once a pass, so it should be a written table; the bin of the middle rank becomes the next range."""
    x = F.col(column)
    n, low, high = values.agg(F.count(x), F.min(x), F.max(x)).first()
    if not n:
        return None
    first, second, before = (n - 1) // 2, n // 2, 0  # the middle ranks, from 0
    while low < high:
        place = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((x - F.lit(low)) / (F.lit(high) - F.lit(low)) * BINS)))
        bins = values.where(x.between(low, high)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("a"), F.max(x).alias("b")).orderBy("a").collect()
        for k, b in enumerate(bins):
            if first < before + b.n:
                if second >= before + b.n:  # the middle lies between two bins
                    return (b.b + bins[k + 1].a) / 2
                low, high = b.a, b.b
                break
            before += b.n
    return low


def thresholds(scored: DataFrame, column: str = "overall", mode: str = "exact") -> DataFrame:
    """strict, moderate and lenient cut-offs with mean, std, min, max and median; fixed ones for no scores.

    The median is exact, or (`sketch`) from a mergeable sketch in the same pass as the others, off by `RANK_ERROR` of the ranks."""
    if mode not in ("exact", "sketch"):
        raise ValueError(f"unknown mode {mode!r}")
    q = F.col(column)
    if mode == "exact":
        scored = written(scored.select(q.cast("double").alias(column)), scratch(scored.sparkSession, "thresholds"))
        middle = F.lit(median(scored, column)).cast("double")
    else:
        middle = F.when(F.count(q) > 0, F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(q.cast("double"), F.lit(SKETCH)), F.lit(0.5)))
    a = scored.agg(F.avg(q).alias("mean"), F.stddev_pop(q).alias("std"), F.min(q).alias("min"), F.max(q).alias("max"), middle.alias("median"))
    return a.select(
        F.when(F.col("mean").isNull(), F.lit(0.8)).otherwise(F.least(F.lit(0.95), F.col("mean") + F.col("std"))).alias("strict"),
        F.coalesce("mean", F.lit(0.6)).alias("moderate"),
        F.when(F.col("mean").isNull(), F.lit(0.4)).otherwise(F.greatest(F.lit(0.3), F.col("mean") - F.col("std"))).alias("lenient"),
        "mean",
        "std",
        "min",
        "max",
        "median",
    )
