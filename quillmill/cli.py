"""Commands over pipelines and the store: python -m quillmill.cli COMMAND. Each prints JSON lines."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import quillmill
from quillmill.operators import facts, generate, query, repair, score, temporal, validate
from quillmill.plans import log
from quillmill.plans.config import Config
from quillmill.plans.pipeline import Pipeline, load_yaml
from quillmill.plans.scratch import scratch, written
from quillmill.plans.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillmill")
    p.add_argument("--store", help="folder of the data sets; storage.base_path of the settings otherwise")
    p.add_argument("--log-level", default="WARNING")
    p.add_argument("--log-file")
    top = p.add_subparsers(dest="command", required=True)
    run = top.add_parser("run", help="run a pipeline file (YAML or JSON)")
    run.add_argument("file")
    data = top.add_parser("dataset").add_subparsers(dest="what", required=True)
    data.add_parser("list")
    for name in ("info", "delete"):
        data.add_parser(name).add_argument("name")
    gen = top.add_parser("generate").add_subparsers(dest="what", required=True)
    for name in ("self-instruct", "temporal-facts"):
        g = gen.add_parser(name)
        g.add_argument("name", help="the data set to write")
        g.add_argument("--url", help="the completion server; llm.url of the settings otherwise")
        if name == "self-instruct":
            g.add_argument("--seeds", required=True, help="the data set whose instructions are the seeds")
            g.add_argument("--per-seed", type=int, default=5)
            g.add_argument("--target", type=int, default=100)
        else:
            g.add_argument("--groups", type=int, default=20)
            g.add_argument("--variations", type=int, default=7)
            g.add_argument("--start", default="2024-01-01")
            g.add_argument("--end", default="2024-01-31")
            g.add_argument("--frequency", default="hourly")
            g.add_argument("--domain", default="news", choices=facts.DOMAINS)
            g.add_argument("--evolution", action="store_true")
    check = top.add_parser("validate").add_subparsers(dest="what", required=True)
    check.add_parser("check").add_argument("name")
    fix = check.add_parser("repair")
    fix.add_argument("name")
    fix.add_argument("--strategy", choices=["truncate", "summarize", "rewrite"], default="truncate")
    fix.add_argument("--url")
    fix.add_argument("--dry-run", action="store_true")
    top.add_parser("quality").add_argument("name")
    show = top.add_parser("review", help="the samples as a table of previews")
    show.add_argument("name")
    show.add_argument("--status")
    show.add_argument("--limit", type=int, default=20)
    top.add_parser("version")
    return p


def kind_of(samples: DataFrame) -> str:
    """`temporal` where a sample carries a time and a group in its custom metadata, else `grpo`."""
    if "custom_json" not in samples.columns:
        return "grpo"
    return "temporal" if samples.where("get_json_object(custom_json, '$.group_id') is not null").take(1) else "grpo"


def _facts_of(samples: DataFrame) -> DataFrame:
    at = lambda k: f"get_json_object(custom_json, '$.{k}')"
    return samples.selectExpr("idx", "instruction as fact", f"{at('timestamp')} as timestamp", f"{at('group_id')} as group_id", f"cast({at('variation_id')} as int) as variation_id")


def main(argv: list[str] | None = None, spark: SparkSession | None = None, make: Callable[[], generate.TextGenerator] | None = None, say: Callable[[str], None] = print) -> None:
    a, config = parser().parse_args(argv), Config()
    logger = log.setup(a.log_level, a.log_file)
    if a.command == "version":
        say(json.dumps({"version": quillmill.__version__}))
        return
    spark = spark or SparkSession.builder.getOrCreate()
    store = Store(spark, a.store or config.get("storage.base_path"))
    url = getattr(a, "url", None) or config.get("llm.url")
    options = {k: config.get(f"llm.{k}") for k in ("temperature", "top_p", "max_tokens", "timeout")}
    model = make or (lambda: generate.HttpGenerator(url, **options))

    def show(df: DataFrame) -> None:
        for row in df.toJSON().collect():  # summaries, or as many rows as were asked for
            say(row)

    logger.info("%s %s", a.command, getattr(a, "what", ""))
    match a.command, getattr(a, "what", None):
        case "run", _:
            if a.file.endswith(".json"):
                with open(a.file, encoding="utf-8") as f:
                    steps = json.load(f)
            else:
                steps = load_yaml(a.file)
            p = Pipeline(spark, steps, store, make)
            p.run()
            show(p.statistics())
        case "dataset", "list":
            for name, entry in sorted(store.catalog().items()):
                say(json.dumps({"name": name, "format": entry["format"], "sample_count": entry["sample_count"], "updated_at": entry["updated_at"]}))
        case "dataset", "info":
            say(json.dumps({k: v for k, v in store.catalog()[a.name].items() if k != "schema"}))
            if "quality_score" in (samples := store.load(a.name)).columns:
                show(query.store_metadata(samples))
        case "dataset", "delete":
            store.delete(a.name)
        case "generate", "self-instruct":
            rows = written(generate.self_instruct(store.load(a.seeds), model, a.per_seed, a.target), scratch(spark, "instructed"))
            number = F.row_number().over(Window.orderBy("seed", "instruction", "response")) - 1  # `target` rows at most
            rows = rows.select(number.cast("long").alias("idx"), "*")
            rows = rows.withColumns({"quality_score": F.lit(None).cast("double"), "review_status": F.lit("pending")})
            say(json.dumps({"sample_count": store.save(rows, a.name, "parquet")["sample_count"]}))
        case "generate", "temporal-facts":
            write = facts.stories if a.evolution else facts.variations
            groups = write(spark, model, a.groups, a.variations, a.domain)
            rows = written(facts.dated(groups, a.groups, a.start, a.end, a.variations, a.frequency), scratch(spark, "facts"))
            store.save(facts.to_samples(rows, a.evolution), a.name, "parquet")
            show(facts.span(rows))
        case "validate", "check":
            samples = store.load(a.name)
            show(temporal.summary(_facts_of(samples)) if kind_of(samples) == "temporal" else validate.summary(samples))
        case "validate", "repair":
            samples = store.load(a.name)
            limits = repair.TEMPORAL_LIMITS if kind_of(samples) == "temporal" else None
            shorten = {"truncate": repair.by_truncation, "summarize": repair.by_model(model), "rewrite": repair.by_retelling(model)}[a.strategy]
            fixed = written(repair.repaired(samples, limits, shorten), scratch(spark, "repaired"))
            show(fixed.groupBy("status").count().orderBy("status"))
            if not a.dry_run:
                store.save(samples, f"{a.name}_backup", store.catalog()[a.name]["format"])
                store.update(repair.applied(fixed, samples.columns), a.name)
        case "quality", _:
            scored = score.score(store.load(a.name)).drop(*score.WEIGHTS, "quality_score").withColumnRenamed("overall", "quality_score")
            scored = written(scored, scratch(spark, "scored"))
            store.update(scored, a.name)
            show(query.score_summary(scored))
        case "review", _:
            show(query.preview(store.load(a.name), a.status).limit(a.limit))


if __name__ == "__main__":
    main()
