"""Row validation: errors and warnings as arrays, data-set summaries, task validators."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import any_in, blank, starts_any, strip, words
from quillmill.operators.score import QUESTION_WORDS

LIMITS = {"instruction": (10, 5000), "response": (20, 10000)}


def _said(*pairs: tuple[Column, Column]) -> Column:
    """The texts whose condition holds."""
    return F.filter(F.array(*[F.when(cond, text) for cond, text in pairs]), lambda x: x.isNotNull())


def errors(limits: dict[str, tuple[int, int]] | None = None) -> Column:
    """All errors of a sample, in the order missing, lengths, white space."""
    limits, missing, lengths, empty = limits or LIMITS, [], [], []
    for name in ("instruction", "response"):
        c, (least, most) = F.col(name), limits[name]
        size, there = F.length(c).cast("string"), ~blank(c)
        missing.append((blank(c), F.lit(f"Missing required field: {name}")))
        lengths.append((there & (F.length(c) < least), F.concat(F.lit(f"{name} too short: "), size, F.lit(f" chars (min: {least})"))))
        lengths.append((there & (F.length(c) > most), F.concat(F.lit(f"{name} too long: "), size, F.lit(f" chars (max: {most})"))))
        empty.append((there & (strip(c) == ""), F.lit(f"{name} is empty or whitespace-only")))
    return _said(*missing, *lengths, *empty)


def validate(samples: DataFrame, limits: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """The samples with `errors` and `valid`."""
    return samples.withColumn("errors", errors(limits)).withColumn("valid", F.size("errors") == 0)


def valid_only(samples: DataFrame, limits: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    return validate(samples, limits).where("valid").drop("errors", "valid")


def summary(samples: DataFrame, limits: dict[str, tuple[int, int]] | None = None, stop_on_first_error: bool = False) -> DataFrame:
    """total, valid, invalid, n_errors, all_valid; up to the first invalid row if so asked."""
    checked = validate(samples, limits)
    if stop_on_first_error:
        first = checked.where(~F.col("valid")).agg(F.min("idx").alias("first"))
        checked = checked.crossJoin(F.broadcast(first)).where(F.col("first").isNull() | (F.col("idx") <= F.col("first")))  # one row
    return checked.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("valid").alias("valid"),
        F.count_if(~F.col("valid")).alias("invalid"),
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("n_errors"),
        (F.count_if(~F.col("valid")) == 0).alias("all_valid"),
    )


def error_list(samples: DataFrame, limits: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """idx, message: one row an error, the message led by the sample's index."""
    rows = samples.select("idx", F.posexplode(errors(limits)).alias("at", "e"))
    return rows.select("idx", "at", F.concat(F.lit("Sample "), F.col("idx").cast("string"), F.lit(": "), F.col("e")).alias("message"))


def math_warnings(response: Column) -> Column:
    answer = any_in(F.lower(response), ["answer:", "=", "solution:", "result:"])
    return _said(
        (~answer, F.lit("Response may not contain explicit answer")),
        (~any_in(response, ["+", "-", "*", "/", "=", "^"]), F.lit("Response may not contain mathematical notation")),
    )


def is_question(text: Column) -> Column:
    return F.endswith(strip(text), F.lit("?")) | starts_any(F.lower(text), QUESTION_WORDS)


def qa_warnings(instruction: Column, response: Column) -> Column:
    return _said(
        (~is_question(instruction), F.lit("Instruction may not be a question")),
        (F.length(response) < F.length(instruction), F.lit("Response may be too short relative to question")),
    )


def code_blocks(text: Column) -> Column:
    """The fenced blocks: odd parts between fences, without a first line if there are more, stripped."""
    parts = F.filter(F.split(text, "```"), lambda x, i: i % 2 == 1)
    return F.transform(parts, lambda p: strip(F.when(F.contains(p, F.lit("\n")), F.regexp_replace(p, r"(?s)\A[^\n]*\n", "")).otherwise(p)))


def syntax_errors(blocks: Column) -> Column:
    """A message for each block that isn't Python; Spark has no parser for it."""

    def of(all_blocks) -> list[str]:
        out = []
        for k, code in enumerate(all_blocks if all_blocks is not None else []):
            try:
                ast.parse(code)
            except (SyntaxError, ValueError) as e:
                out.append(f"Code block {k + 1} may have syntax errors: {e}")
            except (MemoryError, RecursionError):
                out.append(f"Code block {k + 1} may have syntax errors: too deeply nested to parse")
        return out

    def run(all_: pd.Series) -> pd.Series:
        return all_.map(of)

    return F.pandas_udf(run, "array<string>")(blocks)


def code_warnings(response: Column) -> Column:
    none = F.size(code_blocks(response)) == 0
    return F.when(none, F.array(F.lit("No code blocks found in response"))).otherwise(syntax_errors(code_blocks(response)))


def text_statistics(samples: DataFrame) -> DataFrame:
    """Characters, words and lines of both fields."""
    out = samples.select("idx", *[F.coalesce(c, F.lit("")).alias(c) for c in ("instruction", "response")])
    return out.select(
        "idx",
        *[
            f.alias(f"{c}_{n}")
            for c in ("instruction", "response")
            for n, f in (("chars", F.length(c)), ("words", F.size(words(F.col(c)))), ("lines", F.size(F.split(c, "\n"))))
        ],
    )
