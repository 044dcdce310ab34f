"""A generation job goes on after a kill without a second call for what is finished."""

import time

import pytest
from pyspark.sql import functions as F

from quillmill.operators import temporal
from quillmill.plans.job import GenerationJob, answered
from quillmill.plans.pipeline import Pipeline


def models(folder, dies=None):
    """Makes models that note their calls in a folder, a file each, and answer by rule."""

    class Model:
        def generate(self, prompt):
            import os
            import uuid
            from pathlib import Path

            (Path(folder) / f"{prompt}-{uuid.uuid4().hex}").write_text("")
            if dies and prompt == dies:
                os._exit(1)  # as a lost executor
            if prompt.endswith("7"):
                return None
            if prompt.endswith("9"):
                raise ValueError("bad prompt")
            return prompt.upper()

    return Model


def calls(folder):
    out = {}
    for f in folder.iterdir():
        out[f.name.split("-")[0]] = out.get(f.name.split("-")[0], 0) + 1
    return out


def test_goes_on_after_a_kill(spark, tmp_path):
    made = tmp_path / "calls"
    made.mkdir()
    at = str(made)
    rows = [(str(k), f"p{k:02}") for k in range(40)] + [("none", None)]
    job = GenerationJob(spark, str(tmp_path / "job"), models(at, "p25"), tries=2, pause=0.0)
    job.submit(spark.createDataFrame(rows, "id string, prompt string").coalesce(1), per_batch=10)
    with pytest.raises(Exception):
        job.run()
    first = calls(made)
    finished = {r.prompt for r in job.answers().select("prompt").union(job.errors().select("prompt")).collect()}
    assert 10 <= len(finished) < 41 and "p25" not in finished
    again = GenerationJob(spark, str(tmp_path / "job"), models(at), tries=2, pause=0.0)
    again.submit(spark.createDataFrame([("x", "other")], "id string, prompt string"))  # has its prompts
    told = again.run()
    assert told.agg(F.sum("n"), F.sum("answered")).first()[:] == (41, 32)
    assert {p: n for p, n in calls(made).items() if p in finished} == {p: n for p, n in first.items() if p in finished}
    assert sorted((r.id, r.answer) for r in again.answers().collect()) == sorted((i, p.upper()) for i, p in rows if p and p[-1] not in "79")
    said = {r.prompt: (r.error, r.tries) for r in again.errors().collect()}
    assert said["p07"] == ("no answer", 2) and said["p09"] == ("ValueError: bad prompt", 2) and said[None] == ("no prompt", 0) and len(said) == 9
    before = calls(made)
    again.run()  # nothing is left
    assert calls(made) == before and again.answers().count() == 32
    left = again.retry(str(tmp_path / "retry"))
    left.run()
    assert left.errors().count() == 8 and left.answers().count() == 0


def test_a_pipeline_goes_on_with_its_job(spark, tmp_path):
    made = tmp_path / "calls"
    made.mkdir()
    at, samples = str(made), spark.createDataFrame([(k, f"p{k:02}", "old") for k in range(12)], "idx long, instruction string, response string").coalesce(1)
    step = {"type": "generate", "config": {"strategy": "response_gen", "job": str(tmp_path / "job"), "per_batch": 4, "tries": 1, "pause": 0.0}}

    def run(dies=None):
        p = Pipeline(spark, {"operations": [step]}, make=models(at, dies))
        p.samples = samples
        return p.run()

    with pytest.raises(Exception):
        run("p09")
    out = run().collect()
    assert sorted(r.response for r in out if r.response != "old") == sorted(f"P{k:02}" for k in range(12) if k not in (7, 9)) and len(out) == 22
    assert all(n == 1 for p, n in calls(made).items() if p < "p04")
    with pytest.raises(ValueError):
        Pipeline(spark, {"operations": [{"type": "generate", "config": step["config"] | {"strategy": "evol_instruct"}}]}, make=models(at)).run()


def test_calls_in_flight_are_bounded(spark):
    class Slow:
        running = most = 0

        def generate(self, prompt):
            Slow.running += 1
            Slow.most = max(Slow.most, Slow.running)
            time.sleep(0.05)
            Slow.running -= 1
            return str(Slow.most)

    df = spark.createDataFrame([(k, "p") for k in range(24)], "id long, prompt string").coalesce(1)
    began = time.time()
    got = answered(df, Slow, in_flight=6).collect()
    assert max(int(r.answer) for r in got) == 6 and [r.id for r in got] == [str(k) for k in range(24)]
    assert time.time() - began < 60 and answered(df.limit(0), Slow).count() == 0


def test_pieces_of_a_group(spark):
    rows = [(k, "most", f"fact {k}", f"2024-01-01T{k // 3600:02}:{k // 60 % 60:02}:{k % 60:02}", k + 1) for k in range(500)]
    late = [(k, "late", f"f{k % 7}", "2024-01-01T00:00:00" if k == 260 else f"2024-01-02T00:{k // 60:02}:{k % 60:02}", k) for k in range(300)]
    odd = [(1, None, None, "no time", None), (5, "one", " F ", "2024-01-01T00:00:00", 1), (6, "one", "f", None, 1)]
    df = spark.createDataFrame(rows + late + odd, "idx long, group_id string, fact string, timestamp string, variation_id int")
    want = {r.group_id: tuple(r) for r in temporal.groups(df).collect()}
    assert want["most"][1:] == (500, True, 0, True) and want["late"][1:] == (300, False, 300, False) and want["one"][1:] == (2, False, 2, True) and want[None][1:] == (1, False, 0, True)
    for piece in (1, 3, 64, 260, 261):
        assert {r.group_id: tuple(r) for r in temporal.groups(df, piece=piece).collect()} == want
