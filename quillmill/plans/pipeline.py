"""Declarative pipelines: a list of operations, each from one lazy DataFrame to the next; undo keeps earlier ones."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import dedup, generate, query, repair, score, validate
from quillmill.plans.job import GenerationJob
from quillmill.plans.scratch import scratch, written
from quillmill.plans.store import Store
from quillmill.sources import files

log = logging.getLogger("quillmill.plans")


@dataclass
class Operation:
    name: str
    type: str
    config: dict = field(default_factory=dict)


def parse(config: dict) -> list[Operation]:
    return [Operation(o.get("name", o["type"]), o["type"], o.get("config", {})) for o in config.get("operations", [])]


def load_yaml(path: str) -> dict:
    import yaml  # optional: only where pipelines are kept as YAML

    with open(path) as f:
        return yaml.safe_load(f)


def _append(df: DataFrame | None, new: DataFrame) -> DataFrame:
    """New samples after the old ones; idx goes on from the largest."""
    if df is None:
        return new
    if "idx" in df.columns and "idx" in new.columns:
        last = df.agg(F.coalesce(F.max("idx"), F.lit(-1)).alias("m")).first()[0]
        new = new.withColumn("idx", F.col("idx") + last + 1)
    return df.unionByName(new, allowMissingColumns=True)


#: Strategies of the `generate` operation by name; further ones take the samples, the maker of models and their options.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "self_instruct": generate.self_instruct,
    "evol_instruct": generate.evolve,
    "distillation": generate.respond,
    "response_gen": generate.respond,
    "instruction_gen": generate.ask_about,
    "chain_of_thought": generate.reason,
}
#: Operations beside the pipeline's own methods: each takes the samples and its config.
OPERATIONS: dict[str, Callable[[DataFrame | None, dict], DataFrame]] = {}


class Pipeline:
    def __init__(self, spark: SparkSession, config: dict, store: Store | None = None, make: Callable[[], generate.TextGenerator] | None = None):
        self.spark, self.operations, self.store, self.make = spark, parse(config), store, make
        self.samples: DataFrame | None = None
        self.history: list[tuple[str, DataFrame | None]] = []

    def run(self) -> DataFrame:
        for op in self.operations:
            self.apply(op)
        return self.samples

    def apply(self, op: Operation) -> None:
        step = getattr(self, f"_{op.type}", None)
        if op.type in OPERATIONS:
            step = lambda config: OPERATIONS[op.type](self.samples, config)
        if step is None:
            raise ValueError(f"unknown operation {op.type!r}")
        self.history.append((op.name, self.samples))
        self.samples = step(op.config)

    def undo(self) -> None:
        _, self.samples = self.history.pop()

    def statistics(self) -> DataFrame:
        return query.distributions(self.samples)

    def _source(self, c: dict) -> DataFrame:
        return _append(self.samples if c.get("append", True) else None, files.load(self.spark, c.get("paths") or c["path"]))

    def _generate(self, c: dict) -> DataFrame:
        """With `job`, a folder, responses come from a job that goes on where an earlier run of this pipeline was stopped."""
        strategy = STRATEGIES[c["strategy"]]
        make = self.make or (lambda: generate.HttpGenerator(c["url"]))
        options = {k: v for k, v in c.items() if k not in ("strategy", "url", "job")}
        if "job" not in c:
            return _append(self.samples, strategy(self.samples, make, **options))
        if strategy is not generate.respond:
            raise ValueError("only responses are written by jobs")
        per_batch = options.pop("per_batch", 10_000)
        job = GenerationJob(self.spark, c["job"], make, **options)
        job.submit(self.samples.select(F.col("idx").alias("id"), F.col("instruction").alias("prompt")), per_batch)
        told = job.run().agg(F.sum("n").alias("n"), F.sum("answered").alias("answered")).first()
        log.info("job %s: %s of %s prompts answered", c["job"], told.answered, told.n)
        return _append(self.samples, job.answers().select(F.col("prompt").alias("instruction"), F.col("answer").alias("response")))

    def _validate(self, c: dict) -> DataFrame:
        limits = {k: tuple(c.get(k, v)) for k, v in validate.LIMITS.items()}
        return validate.valid_only(self.samples, limits) if c.get("remove_invalid", True) else validate.validate(self.samples, limits)

    def _repair(self, c: dict) -> DataFrame:
        make = self.make or (lambda: generate.HttpGenerator(c["url"]))
        shorten = {"truncate": lambda: repair.by_truncation, "split": lambda: repair.by_truncation, "summarize": lambda: repair.by_model(make), "rewrite": lambda: repair.by_retelling(make)}[c.get("strategy", "truncate")]()
        return repair.applied(repair.repaired(self.samples, repair.TEMPORAL_LIMITS if c.get("temporal") else None, shorten), self.samples.columns)

    def _quality(self, c: dict) -> DataFrame:
        scored = score.score(self.samples, c.get("weights")).drop(*score.WEIGHTS)
        scored = scored.drop("quality_score").withColumnRenamed("overall", "quality_score")
        # written: filters on the score would otherwise be pushed below it and compute it again
        return written(scored, scratch(self.spark, "scored"))  # read by later steps and by undo

    def _deduplicate(self, c: dict) -> DataFrame:
        out = dedup.unique(self.samples, c.get("field", "instruction")) if c.get("exact", True) else self.samples
        return dedup.near_remove(out, c.get("field", "instruction"), c.get("threshold", 0.85), c.get("keep", "first")) if c.get("near", False) else out

    def _filter(self, c: dict) -> DataFrame:
        return query.select(
            self.samples, (c.get("quality_min"), c.get("quality_max")), c.get("source_types"), c.get("tags"), c.get("tag_mode", "any"), c.get("review_status"), c.get("mode", "bucket")
        )

    def _save(self, c: dict) -> DataFrame:
        self.store.save(self.samples, c["name"], c.get("format", "jsonl"), c.get("metadata"))
        return self.samples

    def _load(self, c: dict) -> DataFrame:
        return self.store.load(c["name"])


def reviewed(samples: DataFrame, edits: DataFrame) -> DataFrame:
    """Batch review: edits(idx, action, instruction, response) approve, reject, edit or delete samples; one edit a sample."""
    e = edits.select(F.col("idx").alias("__idx"), "action", F.col("instruction").alias("__i"), F.col("response").alias("__r"))
    out = samples.join(e, samples["idx"] == F.col("__idx"), "left").where(~F.coalesce(F.col("action") == "delete", F.lit(False)))
    status = F.when(F.col("action") == "approve", "approved").when(F.col("action") == "reject", "rejected").otherwise(F.col("review_status"))
    edit = F.coalesce(F.col("action") == "edit", F.lit(False))
    new = {
        "review_status": status,
        "instruction": F.when(edit, F.coalesce("__i", "instruction")).otherwise(F.col("instruction")),
        "response": F.when(edit, F.coalesce("__r", "response")).otherwise(F.col("response")),
    }
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in samples.columns])
