"""Model-written samples: a generator protocol, strategies over it, and parsers of what models return.

Model calls run in mapInArrow, one client a partition, with retries; parsers are column expressions. A stage's output
should be persisted, since computing it anew would call the model again.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.text import WS, strip
from quillmill.sources.records import generated_samples

#: Prefixes of fallback variations, words of lines that aren't variations, markers that end a fact, marks of a
#: solution and the stock one, types of evolution.
PREFIXES = ["According to reports, ", "It was reported that ", "Sources indicate that ", "Officials confirmed that ", "Data shows that "]
INSTRUCTION_WORDS = ["example", "variation", "write", "rewrite", "original"]
FACT_ENDS = ["Example:", "Your fact", "Generate"]
SOLUTION_MARKS = ["Final answer:", "Therefore,", "The solution is", "Answer:", "Result:"]
STOCK_SOLUTION = "The solution follows from the reasoning above."
EVOLUTIONS = ["add_constraints", "deepen_reasoning", "increase_complexity", "concretize", "increase_breadth"]


class TextGenerator(Protocol):
    def generate(self, prompt: str) -> str | None: ...


@dataclass
class HttpGenerator:
    """A completion server: POST {url}/completion, answer in `content`; None on any failure."""

    url: str
    temperature: float = 0.7
    top_p: float = 0.9
    max_tokens: int = 1024
    timeout: float = 300.0
    top_k: int = 40
    stop: tuple[str, ...] = ()

    def healthy(self) -> bool:
        """Whether the server answers at {url}/health."""
        try:
            with urllib.request.urlopen(f"{self.url}/health", timeout=self.timeout) as reply:
                return reply.status == 200
        except (OSError, ValueError):
            return False

    def wait_ready(self, timeout: float = 60.0, pause: float = 0.5) -> bool:
        """Whether the server became healthy in so many seconds."""
        until = time.monotonic() + timeout
        while not self.healthy():
            if time.monotonic() + pause > until:
                return False
            time.sleep(pause)
        return True

    def properties(self) -> dict:
        """What the server says of itself at {url}/props; nothing if it doesn't answer."""
        try:
            with urllib.request.urlopen(f"{self.url}/props", timeout=self.timeout) as reply:
                found = json.load(reply)
                return found if isinstance(found, dict) else {}
        except (OSError, ValueError):
            return {}

    def generate(self, prompt: str) -> str | None:
        body = {"prompt": prompt, "temperature": self.temperature, "top_p": self.top_p, "top_k": self.top_k, "n_predict": self.max_tokens, "stop": list(self.stop)}
        ask = urllib.request.Request(f"{self.url}/completion", json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(ask, timeout=self.timeout) as reply:
                return json.load(reply)["content"].strip() or None
        except (OSError, ValueError, KeyError, AttributeError, TypeError):
            return None


@dataclass
class EchoGenerator:
    """A deterministic stand-in: text made from the prompt's digest."""

    words: int = 24

    def generate(self, prompt: str) -> str | None:
        d = hashlib.sha256(prompt.encode("utf-8")).hexdigest()
        return "Answer " + " ".join(d[k % 60 : k % 60 + 4] for k in range(self.words)) + "."


def generated(df: DataFrame, make: Callable[[], TextGenerator], prompt: str = "prompt", out: str = "answer", retries: int = 3, pause: float = 1.0) -> DataFrame:
    """df with a column of the model's answers to `prompt`; null where all tries came back empty or there is no prompt."""
    df = df.drop(out)
    at, names = df.columns.index(prompt), [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()

        def ask(text: str | None) -> str | None:
            for k in range(retries if text is not None else 0):
                if found := model.generate(text):
                    return found
                if k + 1 < retries:
                    time.sleep(pause * 2**k)
            return None

        for b in batches:
            answers = pa.array([ask(x) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, answers], names=names)

    return df.mapInArrow(run, df.select("*", F.lit(None).cast("string").alias(out)).schema)


#: The seeds of a run that names none.
SEEDS = [
    "Write a function to calculate the factorial of a number",
    "Explain the concept of object-oriented programming",
    "Describe how to make a basic web server",
    "Write a poem about nature",
    "Explain the Pythagorean theorem",
    "Describe the water cycle",
    "Write a tutorial on binary search",
    "Explain quantum computing in simple terms",
    "Describe the process of photosynthesis",
    "Write a guide to basic data structures",
]


def self_instruct(seeds: DataFrame | None, make: Callable[[], TextGenerator], per_seed: int = 5, target: int = 100) -> DataFrame:
    """instruction, response, seed, and metadata: new instructions after each seed (`SEEDS` if there are none), then their
    answers; short ones are dropped."""
    if seeds is None:
        seeds = SparkSession.active().createDataFrame([(x,) for x in SEEDS], "instruction string")
    ask = F.concat(F.lit("Write one new instruction, different from this one: "), F.col("seed"), F.lit(" Number "), F.col("k").cast("string"))
    rows = seeds.select(F.col("instruction").alias("seed"), F.explode(F.sequence(F.lit(1), F.lit(per_seed))).alias("k")).withColumn("prompt", ask)
    rows = generated(rows, make, out="instruction").where(F.length("instruction") >= 20)
    rows = generated(rows.withColumn("prompt", F.col("instruction")), make, out="response").where(F.length("response") >= 50)
    return generated_samples(rows.limit(target), ("self_instruct",), ("seed",), seed_task=F.col("seed"), generation_index=F.col("k") - 1)


def evolve(instructions: DataFrame, make: Callable[[], TextGenerator], rounds: int = 2) -> DataFrame:
    """instruction, response, original: each round rewrites by the next evolution type; rows that fail stop."""
    rows = instructions.select(F.col("instruction").alias("original"), "instruction")
    for r in range(rounds):
        ask = F.concat(F.lit(f"Rewrite, {EVOLUTIONS[r % len(EVOLUTIONS)].replace('_', ' ')}: "), F.col("instruction"))
        rows = generated(rows.withColumn("prompt", ask).drop("instruction"), make, out="instruction").drop("prompt").where("instruction is not null")
    rows = generated(rows.withColumn("prompt", F.col("instruction")), make, out="response").where("response is not null")
    return rows.select("instruction", "response", "original")


def respond(prompts: DataFrame, make: Callable[[], TextGenerator]) -> DataFrame:
    """instruction, response: a teacher's answers (distillation and response generation)."""
    rows = prompts.select("instruction", F.col("instruction").alias("prompt"))
    return generated(rows, make, out="response").where("response is not null").select("instruction", "response")


def ask_about(documents: DataFrame, make: Callable[[], TextGenerator], questions: int = 5, types: tuple[str, ...] = ("factual", "analytical"), most: int = 2000) -> DataFrame:
    """instruction, response: questions on each document's first `most` characters, types taking turns, and answers."""
    kind = F.element_at(F.array(*map(F.lit, types)), F.pmod(F.col("k"), F.lit(len(types))) + 1)
    rows = documents.select(F.substring("text", 1, most).alias("text"), F.explode(F.sequence(F.lit(0), F.lit(questions - 1))).alias("k"))
    rows = rows.withColumn("prompt", F.concat(F.lit("Ask one "), kind, F.lit(" question, number "), F.col("k").cast("string"), F.lit(", on: "), F.col("text")))
    rows = generated(rows, make, out="instruction").where("instruction is not null")
    rows = generated(rows.withColumn("prompt", F.concat("instruction", F.lit("\n"), "text")), make, out="response").where("response is not null")
    return rows.select("instruction", "response")


def reason(problems: DataFrame, make: Callable[[], TextGenerator]) -> DataFrame:
    """instruction, response: chains of thought, split and marked."""
    ask = F.concat(F.lit("Think step by step, then give the final answer: "), F.col("instruction"))
    rows = generated(problems.select("instruction", ask.alias("prompt")), make).where("answer is not null")
    return rows.select("instruction", chain_format(*chain_split(F.col("answer"))).alias("response"))


def chain_split(text: Column) -> tuple[Column, Column]:
    """Reasoning and solution: at the first listed mark that occurs, else before the last paragraph, else a stock line."""
    parts = F.split(strip(text), "\n\n", -1)
    several = F.size(parts) > 1
    thought = F.when(several, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "\n\n")).otherwise(text)
    answer = F.when(several, F.element_at(parts, -1)).otherwise(F.lit(STOCK_SOLUTION))
    for m in reversed(SOLUTION_MARKS):
        at = F.instr(text, m)
        thought = F.when(at > 0, strip(F.substring(text, F.lit(1), at - 1))).otherwise(thought)
        answer = F.when(at > 0, strip(F.substring(text, at, F.length(text)))).otherwise(answer)
    return thought, answer


def chain_format(thought: Column, answer: Column, marks: tuple[str, str, str, str] = ("<think>", "</think>", "<solution>", "</solution>")) -> Column:
    a, b, c, d = marks
    return F.concat(F.lit(f"{a}\n"), thought, F.lit(f"\n{b}\n\n{c}\n"), answer, F.lit(f"\n{d}"))


def clean_fact(text: Column) -> Column:
    """A fact without a leading label, number, quotes or trailing instructions; null if nothing is left."""
    f = strip(text)
    f = F.when(F.contains(f, F.lit(":")), strip(F.regexp_replace(f, r"(?s)\A[^:]*:", ""))).otherwise(f)
    f = F.when(f.rlike(r"\A\p{Nd}") & F.contains(f, F.lit(".")), strip(F.regexp_replace(f, r"(?s)\A[^.]*\.", ""))).otherwise(f)
    f = F.regexp_replace(f, r"""\A["']+|["']+\z""", "")
    for m in FACT_ENDS:
        f = F.when(F.contains(f, F.lit(m)), strip(F.substring_index(f, m, 1))).otherwise(f)
    return F.nullif(f, F.lit(""))


def parse_variations(text: Column, seed: Column) -> Column:
    """The usable lines of a list that a model wrote."""

    def usable(line: Column) -> Column:
        low, keep = F.lower(line), line != ""
        for w in INSTRUCTION_WORDS:
            keep = keep & ~F.contains(low, F.lit(w))
        return keep & ~(line.rlike(r"\A\p{Nd}") & ~F.contains(line, F.lit(".")))

    def bare(line: Column) -> Column:
        line = F.when(line.rlike(r"\A\p{Nd}"), strip(F.regexp_replace(line, r"\A[^.]*\.", ""))).otherwise(line)
        return F.regexp_replace(strip(F.regexp_replace(line, r"\A[-*•]+", "")), r"""\A["']+|["']+\z""", "")

    lines = F.transform(F.split(strip(text), "\n"), strip)
    return F.filter(F.transform(F.filter(lines, usable), bare), lambda v: (F.length(v) > 15) & (F.lower(v) != F.lower(seed)))


def fallback_variations(seed: Column, n: int = 7) -> Column:
    """The seed and up to five prefixed forms of it, its first letter lowered."""
    low = F.concat(F.lower(F.substring(seed, 1, 1)), F.substring(seed, F.lit(2), F.length(seed)))
    return F.slice(F.concat(F.array(seed), F.transform(F.array(*map(F.lit, PREFIXES[: max(0, n - 1)])) if n > 1 else F.array().cast("array<string>"), lambda p: F.concat(p, low))), 1, n)


def cut_event(text: Column, most: int = 300, least: int = 50) -> Column:
    """An expanded event in one line, cut at the last full stop beyond 80 % of the limit; null if shorter than `least`."""
    line = strip(F.regexp_replace(text, f"{WS}+", " "))
    cut = F.substring(line, 1, most)
    stop = F.length(F.regexp_extract(cut, r"(?s)\A(.*\.)", 1))
    out = F.when(F.length(line) <= most, line).when(stop > 0.8 * most, F.substring(cut, F.lit(1), stop)).otherwise(cut)
    return F.when(F.length(out) >= least, out)


VERDICT = "all_consistent boolean, duplicate_indices array<int>, inconsistent_indices array<int>, issues_description string"


def verdict(text: Column) -> Column:
    """A reviewer's JSON verdict, with or without a code fence; null if it can't be read."""
    bare = F.regexp_replace(strip(text), r"(?s)\A```(?:json)?\s*|\s*```\z", "")
    return F.when(F.try_parse_json(bare).isNotNull(), F.from_json(bare, VERDICT))
