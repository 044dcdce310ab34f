"""Repair of over-long texts at sentence, paragraph or word ends, and its reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import WS, any_in, blank, rstrip, strip
from quillmill.operators.generate import TextGenerator, generated
from quillmill.operators.validate import LIMITS, errors
from quillmill.plans.scratch import scratch, written

#: What shows that a text is an event of a story, and the limits of temporal facts.
STORY_MARKS = ["**Story Beat", "Marcus ", "Jalen ", "Maya ", '" ', "DM from", "replied:", "The message read:"]
TEMPORAL_LIMITS = {"instruction": (20, 1200), "response": (0, 100_000)}


def truncate(text: Column, most: int) -> Column:
    """Cut at the last sentence end beyond 70 % of the limit, else paragraph end beyond 70 %, else space beyond 90 %."""
    cut = F.substring(text, 1, most)
    sentence = F.length(F.regexp_extract(cut, rf"(?s)\A(.*[.!?]{WS})", 1))
    paragraph = F.length(F.regexp_extract(cut, r"(?s)\A((?:.*[^\n])?(?:\n\n)+)", 1))
    before = F.regexp_extract(cut, r"(?s)\A(.*) ", 1)
    space = F.when(F.contains(cut, F.lit(" ")), F.length(before)).otherwise(F.lit(-1))
    end = F.when(sentence > 0.7 * most, sentence).when(paragraph > 0.7 * most, paragraph).when(space > 0.9 * most, space).otherwise(F.lit(most))
    return F.when(F.length(text) > most, rstrip(F.substring(cut, F.lit(1), end))).otherwise(text)


Shorten = Callable[[DataFrame, str, int], DataFrame]


def _over(c: str, most: int) -> Column:
    return ~blank(F.col(c)) & (F.length(c) > most)


def _noted(df: DataFrame, c: str, most: int, new: Column, said: str, by: str = "") -> DataFrame:
    """df with the new text and, where the old one is too long, a note on the change."""
    df = df.withColumn(f"__{c}", new)
    note = F.concat(F.lit(f"{said} from "), F.length(c).cast("string"), F.lit(" to "), F.length(f"__{c}").cast("string"), F.lit(f" chars{by}"))
    return df.withColumn(f"__note_{c}", F.when(_over(c, most), note))


def by_truncation(df: DataFrame, c: str, most: int) -> DataFrame:
    return _noted(df, c, most, truncate(F.col(c), most), f"Truncated {c}")


def _asked(df: DataFrame, c: str, most: int, make: Callable[[], TextGenerator], task: Column) -> DataFrame:
    """df with __answer, of rows that are too long. Written, since the model would be called again otherwise."""
    prompt = F.when(_over(c, most), F.concat(task, F.lit(f" Stay below {int(0.9 * most)} characters.\n\n"), F.col(c)))
    df = generated(df.withColumn("__prompt", prompt), make, "__prompt", "__answer").drop("__prompt")
    return written(df, scratch(df.sparkSession, "shortened"))


def by_model(make: Callable[[], TextGenerator]) -> Shorten:
    """A model condenses what is too long; no answer, or one that is too long, is truncated."""

    def shorten(df: DataFrame, c: str, most: int) -> DataFrame:
        df = _asked(df, c, most, make, F.lit(f"Condense this {c}; keep its requirements, facts and intent."))
        new = F.when(_over(c, most), truncate(strip(F.coalesce("__answer", c)), most)).otherwise(F.col(c))
        return _noted(df, c, most, new, f"Condensed {c}", " using LLM").drop("__answer")

    return shorten


def by_retelling(make: Callable[[], TextGenerator], evolution: Column | None = None) -> Shorten:
    """A model retells a fact or a story's event in one line; an answer that isn't shorter is replaced by truncation."""

    def shorten(df: DataFrame, c: str, most: int) -> DataFrame:
        story = any_in(F.col(c), STORY_MARKS) | (F.coalesce(evolution, F.lit(False)) if evolution is not None else F.lit(False))
        task = F.when(story, "Shorten this event of a story; keep what happens and the dialogue.").otherwise("Shorten this fact; keep all its numbers and names.")
        df = _asked(df, c, most, make, task)
        line = F.regexp_replace(strip(F.substring_index(strip(F.col("__answer")), "\n", 1)), r"""\A["']+|["']+\z""", "")
        better = (line != "") & (F.length(line) < F.length(c)) & (F.length(line) <= most)
        new = F.when(_over(c, most), F.when(better, line).otherwise(truncate(F.col(c), most))).otherwise(F.col(c))
        return _noted(df, c, most, new, "Rewrote text", " using LLM").drop("__answer")

    return shorten


def repaired(samples: DataFrame, limits: dict[str, tuple[int, int]] | None = None, shorten: Shorten = by_truncation) -> DataFrame:
    """The samples with rep_instruction, rep_response, changes and status (already_valid, repaired or failed).

    Failed samples keep their texts."""
    limits = limits or LIMITS
    out = samples.withColumn("__before", errors(limits))
    for c in ("instruction", "response"):
        out = shorten(out, c, limits[c][1])
    out = out.withColumn("changes", F.filter(F.array("__note_instruction", "__note_response"), lambda x: x.isNotNull()))
    kept = {c: F.col(c) for c in samples.columns if c not in ("instruction", "response")}
    after = out.select(*[F.col(c) for c in out.columns if c not in ("instruction", "response")], F.col("instruction").alias("__old_i"), F.col("response").alias("__old_r"), F.col("__instruction").alias("instruction"), F.col("__response").alias("response"))
    after = after.withColumn("__after", errors(limits))
    status = F.when(F.size("__before") == 0, "already_valid").when((F.size("changes") > 0) & (F.size("__after") == 0), "repaired").otherwise("failed")
    after = after.withColumn("status", status)
    fixed = F.col("status") == "repaired"
    return after.select(
        *kept.values(),
        F.col("__old_i").alias("instruction"),
        F.col("__old_r").alias("response"),
        F.when(fixed, F.col("instruction")).otherwise(F.col("__old_i")).alias("rep_instruction"),
        F.when(fixed, F.col("response")).otherwise(F.col("__old_r")).alias("rep_response"),
        F.when(fixed, F.col("changes")).otherwise(F.array().cast("array<string>")).alias("changes"),
        "status",
    )


def report(samples: DataFrame, limits: dict[str, tuple[int, int]] | None = None, shorten: Shorten = by_truncation) -> DataFrame:
    """Counts by outcome, and valid samples before and after."""
    n = {s: F.count_if(F.col("status") == s).alias(s) for s in ("already_valid", "repaired", "failed")}
    out = repaired(samples, limits, shorten).agg(F.count(F.lit(1)).alias("total"), *n.values())
    return out.withColumn("valid_after", F.col("already_valid") + F.col("repaired"))


def applied(fixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of `repaired` as samples with their new texts."""
    new = {"instruction": "rep_instruction", "response": "rep_response"}
    return fixed.select(*[F.col(new.get(c, c)).alias(c) for c in columns])
