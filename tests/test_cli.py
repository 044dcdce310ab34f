"""Commands, end to end, on a store in a temporary folder."""

import json
import logging

from quillmill import cli
from quillmill.operators.generate import EchoGenerator
from quillmill.plans import log
from quillmill.plans.store import Store

SAMPLE = "idx long, instruction string, response string, source_type string, tags array<string>, quality_score double, review_status string"


def run(spark, store, *argv):
    out = []
    cli.main(["--store", store, *argv], spark, lambda: EchoGenerator(), out.append)
    return [json.loads(x) for x in out]


def test_store_commands(spark, tmp_path):
    store = str(tmp_path / "sets")
    rows = [(0, "What is a long enough question?", "An answer. " * 2000, "s", ["a", "b", "c", "d"], None, "pending"), (1, "short", "too", "s", None, 0.5, "approved"), (2, "Why do rivers run to the sea?", "Because water runs downhill.", "s", [], 0.7, "pending")]
    Store(spark, store).save(spark.createDataFrame(rows, SAMPLE), "one", "parquet")
    assert [r["sample_count"] for r in run(spark, store, "dataset", "list")] == [3]
    assert run(spark, store, "validate", "check", "one")[0]["valid"] == 1
    fixed = {r["status"]: r["count"] for r in run(spark, store, "validate", "repair", "one")}
    assert fixed == {"already_valid": 1, "failed": 1, "repaired": 1}
    assert run(spark, store, "validate", "check", "one")[0]["valid"] == 2
    assert [r["name"] for r in run(spark, store, "dataset", "list")] == ["one", "one_backup"]
    assert 0 < run(spark, store, "quality", "one")[0]["mean"] <= 1
    shown = run(spark, store, "review", "one", "--status", "pend")
    assert [r["idx"] for r in shown] == [0, 2] and shown[0]["response"].endswith("...") and shown[0]["tags"] == "a, b, c" and shown[0]["quality"] != "N/A"
    run(spark, store, "dataset", "delete", "one")
    assert [r["name"] for r in run(spark, store, "dataset", "list")] == ["one_backup"]
    assert run(spark, store, "dataset", "info", "one_backup")[0]["sample_count"] == 3
    assert run(spark, store, "version")[0]["version"]


def test_generate_and_run(spark, tmp_path):
    store = str(tmp_path / "sets")
    Store(spark, store).save(spark.createDataFrame([("Tell a story about a fox",)], "instruction string"), "seeds", "jsonl")
    n = run(spark, store, "generate", "self-instruct", "made", "--seeds", "seeds", "--per-seed", "3")[0]["sample_count"]
    assert n == 3 and [r["idx"] for r in run(spark, store, "review", "made")] == [0, 1, 2]
    assert run(spark, store, "generate", "temporal-facts", "dated", "--groups", "2", "--variations", "3")[0] == {"n": 6, "first": "2024-01-01T00:00:00", "last": "2024-01-16T02:00:00", "days": 15, "groups": 2}
    assert run(spark, store, "validate", "check", "dated")[0]["group_count"] == 2
    steps = tmp_path / "steps.json"
    steps.write_text(json.dumps({"operations": [{"type": "load", "config": {"name": "made"}}, {"type": "repair"}, {"type": "save", "config": {"name": "again", "format": "json"}}]}))
    assert {r["kind"] for r in run(spark, store, "run", str(steps))} == {"source", "status", "tag"}
    assert [r["name"] for r in run(spark, store, "dataset", "list")] == ["again", "dated", "made", "seeds"]


def test_log_rolls_over(tmp_path):
    logger = log.setup("INFO", str(tmp_path / "x.log"), most=200, keep=2)
    for k in range(20):
        logger.info("line %d of the log", k)
    logging.shutdown()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["x.log", "x.log.1.gz", "x.log.2.gz"]
    log.setup()
