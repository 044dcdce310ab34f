"""Facts, stories and repairs that a model writes, with scripted models."""

import json
import sys

from pyspark import cloudpickle

from quillmill.operators import facts, repair, temporal

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
NOW = {"retries": 2, "pause": 0.0}


class Scripted:
    """Answers by the start of the prompt."""

    def generate(self, prompt):
        if prompt.startswith("Write one"):
            return None if prompt.endswith("Number 2") else 'Fact: "Exports rose by 12 percent in May 2023"'
        if prompt.startswith("Say this"):
            return "1. In May 2023 exports grew 12 percent\n2. Exports gained 99 percent in May 2023\nshort\nNow write more of these please"
        if prompt.startswith("Review"):
            return "```json\n" + json.dumps({"all_consistent": False, "duplicate_indices": [9], "inconsistent_indices": [1], "issues_description": "x"}) + "\n```"
        if prompt.startswith("Rewrite"):
            assert "figures differ" in prompt
            return "Statement: Exports gained 12 percent in May 2023"
        if prompt.startswith("Outline"):
            return None if prompt.endswith("Number 1") else "\n".join(f"{k}. The council met for the {k}th time about the bridge" for k in range(1, 4))
        if prompt.startswith("Tell"):
            return None if "2th" in prompt.split("\n")[0] else "Expanded event: " + "The council spoke at length about the old bridge. " * 3 + ("then" if "Before it:\n- The" in prompt else "first")
        if prompt.startswith("Condense"):
            return "A condensed text of good length, done."
        if prompt.startswith("Shorten this event"):
            return "x" * 5000
        return "Short fact with 12 percent.\nAnd a note"


def test_variations_are_reviewed_and_dated(spark):
    got = facts.variations(spark, Scripted, groups=3, per_group=4, **NOW)
    rows = {r.group_idx: r.facts for r in got.collect()}
    seed = "Exports rose by 12 percent in May 2023"
    assert rows == {g: ["In May 2023 exports grew 12 percent", "Exports gained 12 percent in May 2023", seed, seed] for g in (0, 2)}
    out = facts.dated(got, 3, per_group=4)
    assert [(r.group_id, r.variation_id) for r in out.orderBy("group_id", "variation_id").collect()] == [(g, k) for g in ("group_001", "group_003") for k in (1, 2, 3, 4)]
    s = facts.to_samples(out).first()
    assert s.response == "" and s.tags[2] == "variation" and json.loads(s.custom_json)["evolution_mode"] is False
    assert facts.span(out).first()[0] == 8
    checked = temporal.groups(out).first()
    assert checked.sequential and checked.chronological


def test_unread_verdicts_change_nothing(spark):
    class Bad:
        def generate(self, prompt):
            return "no JSON at all {"

    g = spark.createDataFrame([(0, "seed", ["a", "b"])], "group_idx long, seed string, facts array<string>")
    assert [(r.facts, r.status, r.corrections) for r in facts.reviewed(g, Bad, **NOW).collect()] == [(["a", "b"], "unread", 0)]
    assert facts.reviewed(g.limit(0), Bad, **NOW).count() == 0


def test_stories(spark):
    rows = facts.stories(spark, Scripted, groups=2, per_group=4, **NOW).collect()
    assert [r.group_idx for r in rows] == [1]
    told = rows[0].facts
    assert told[0].startswith("The council spoke") and told[0].endswith("first") and told[2].endswith("then")  # its context starts with event 0
    assert told[1] == "Following the previous developments, the council met for the 2th time about the bridge"
    assert told[3].endswith("first") and len(told) == 4


def test_repair_by_model(spark):
    cols = "idx long, instruction string, response string, quality_score double"
    rows = spark.createDataFrame([(1, "word " * 30, "a fine response, long enough", None), (2, "a good instruction", "z" * 60, 0.5), (3, None, "", None)], cols)
    limits = {"instruction": (10, 50), "response": (20, 40)}
    got = {r.idx: r for r in repair.repaired(rows, limits, repair.by_model(Scripted)).collect()}
    assert (got[1].status, got[1].rep_instruction, got[1].quality_score) == ("repaired", "A condensed text of good length, done.", None)
    assert got[1].changes == ["Condensed instruction from 150 to 38 chars using LLM"] and got[2].status == "repaired" and got[3].status == "failed"
    facts_ = spark.createDataFrame([(1, "word " * 300, "", None), (2, "Maya " * 300, "", None)], cols)
    got = {r.idx: r for r in facts_.transform(lambda d: repair.by_retelling(Scripted)(d, "instruction", 1200)).collect()}
    assert got[1]["__instruction"] == "Short fact with 12 percent." and got[2]["__instruction"].startswith("Maya Maya") and len(got[2]["__instruction"]) <= 1200
