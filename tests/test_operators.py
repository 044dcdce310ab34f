"""Edge rows, round trips and brute-force comparisons of the sample operators."""

import importlib
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.operators import dedup, generate, query, repair, score, temporal, validate
from quillmill.operators.components import components
from quillmill.plans import pipeline, queries
from quillmill.plans.config import Config
from quillmill.plans.store import Store
from quillmill.sources import files, records
from quillmill.sources.html import clean

SAMPLE = "idx long, instruction string, response string, source_type string, tags array<string>, quality_score double, review_status string"


def samples(spark, rows):
    return spark.createDataFrame([(i, a, b, "s", t, q, "pending") for i, a, b, t, q in rows], SAMPLE)


def dp(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcé", max_size=30), st.text("abcé", max_size=30))
def test_lcs_is_dynamic_programming(a, b):
    assert dedup.lcs(a, b) == dp(a, b)


@settings(max_examples=300, deadline=None)
@given(st.text("ab c", max_size=200), st.text("ab c", max_size=30), st.integers(0, 200), st.integers(0, 230))
def test_bounded_lcs(a, extra, cut, need):
    b = a[cut:] + extra + a[:cut] if need % 2 else a[:cut] + extra + a[cut + 3 :]
    n = dp(a, b)
    for bound in {need, n, n + 1, max(0, n - 1)}:
        assert dedup.lcs(a, b, bound) == (n if n >= bound else -1)


def test_near_pairs_are_all_pairs(spark):
    base = "the quick brown fox jumps over the lazy dog again and again"
    texts = ["", "", base, base + "!", base[3:], base.replace("fox", "cat"), "short", "shorts", "something else entirely, of another length", None, base]
    df = samples(spark, [(i, t, "r", [], None) for i, t in enumerate(texts)])
    plain = [t or "" for t in texts]
    want = {(i, j) for i in range(len(plain)) for j in range(i + 1, len(plain)) if dedup.ratio(plain[i], plain[j]) >= 0.85}
    got = {(r.i, r.j) for r in dedup.similar_pairs(df).collect()}
    assert got <= want
    # equal texts are linked to their first only, so compare the groups, and the pairs by count
    assert dedup.stats(df).first().near_duplicate_pairs == len(want)
    root = {}
    for i, j in sorted(want):
        root[j] = min(root.get(j, j), root.get(i, i))
    groups = {r.idx: r.component for r in dedup.near_groups(df).where("component is not null").collect()}
    assert groups == {i: root.get(i, i) for i in {x for p in want for x in p}}


def test_short_texts_are_compared_many_at_once(monkeypatch):
    rng, ratio = random.Random(3), dedup.ratio
    assert dedup._links([(1, "ab"), (2, "cd")], None, 0.85) == []
    edited = lambda t, p: "".join(rng.choice(["", x + rng.choice("aé漢😀")]) if rng.random() < p else x for x in t)
    for threshold in (0.5, 0.85, 1.0):
        base = ["".join(rng.choices("abcde é漢😀", k=k)) for k in (1, 30, 63, 64, 65, 128, 129, 500)]
        rows = list(enumerate(sorted({edited(t, p) for t in base for p in (0, 0.05, 0.1, 0.2)} | {""})))
        rng.shuffle(rows)
        want = sorted((min(i, j), max(i, j), sim) for k, (i, a) in enumerate(rows) for j, b in rows[:k] if (sim := ratio(a, b)) >= threshold)
        half = {i for i, _ in rows[: len(rows) // 2]}
        assert sorted(dedup._links(rows, None, threshold)) == want
        monkeypatch.setattr(dedup, "ratio", None)  # one pair at a time
        monkeypatch.setattr(dedup, "FEW", 0)
        for cells in (dedup.CELLS, 300):  # tables too large are made for fewer pairs
            monkeypatch.setattr(dedup, "CELLS", cells)
            assert sorted(dedup._links(rows, None, threshold)) == want
            assert sorted(dedup._links(rows[: len(half)], rows[len(half) :], threshold)) == [x for x in want if (x[0] in half) != (x[1] in half)]
        monkeypatch.undo()


def test_long_texts_are_compared_many_at_once(monkeypatch):
    """Also where one side ends long before the other, letters are the same in all texts, and links lie at the threshold."""
    rng, ratio = random.Random(7), dedup.ratio
    letters = "etaoinshrd lcu" * 230
    base = ["".join(rng.sample(letters[:k], k)) for k in (300, 1000, 1100, 1500, 2200, 3200)]
    moved = lambda t, p: "".join(rng.choice(["", x + rng.choice("eta")]) if rng.random() < p else x for x in t)
    rows = list(enumerate([*base, *(moved(t, p) for t in base for p in (0.1, 0.28, 0.3)), *(t[k:] for t in base for k in (len(t) * 26 // 100, len(t) * 27 // 100)), *(t[90:] + t[:90] for t in base)]))
    rng.shuffle(rows)
    want = sorted((min(i, j), max(i, j), sim) for k, (i, a) in enumerate(rows) for j, b in rows[:k] if (sim := ratio(a, b, 0.85)) >= 0.85)
    monkeypatch.setattr(dedup, "ratio", None)  # one pair at a time
    monkeypatch.setattr(dedup, "FEW", 0)
    for cells, lanes in ((dedup.CELLS, dedup.LANES), (3000, 50)):
        monkeypatch.setattr(dedup, "CELLS", cells)
        monkeypatch.setattr(dedup, "LANES", lanes)
        assert sorted(dedup._links(rows, None, 0.85)) == want and len(want) > 18
        of = {i for i, _ in rows[:15]}
        assert sorted(dedup._links(rows[:15], rows[15:], 0.85)) == [x for x in want if (x[0] in of) != (x[1] in of)]


def test_near_pairs_are_compared_where_their_blocks_meet(spark, monkeypatch):
    """Anagrams, of which all pairs pass the bounds: what is dealt to tasks are texts, once for each block, not pairs."""
    letters = random.Random(3)
    texts = ["".join(letters.sample("etaoinshrd" * 6, 60)) for _ in range(400)]
    texts += [texts[0][:-1], texts[0] + "x" * 21]  # of the band below, or of one above and too long
    dealt, compared = [], dedup._compared
    monkeypatch.setattr(dedup, "ROWS", 90)
    monkeypatch.setattr(dedup, "_compared", lambda rows, t: (dealt.append(rows.count()), compared(rows, t))[1])
    got = {(r.i, r.j): r.sim for r in dedup.similar_pairs(samples(spark, [(i, t, "r", [], None) for i, t in enumerate(texts)])).collect()}
    assert len(texts) <= dealt[0] < 20 * len(texts) < len(texts) * (len(texts) - 1) / 2
    want = {(i, j): s for i in range(len(texts)) for j in range(i + 1, len(texts)) if (s := dedup.ratio(texts[i], texts[j], 0.85)) >= 0.85}
    assert got == want and (0, 400) in want


def test_near_texts_are_shuffled_as_often_with_many_blocks_as_with_few(spark, monkeypatch):
    """And found pairs are read again without comparing anew."""
    letters, sc = random.Random(3), spark.sparkContext
    texts = ["".join(letters.sample("etaoinshrd" * 6, 60)) for _ in range(500)]
    texts += [t[: 50 + k] for k, t in enumerate(texts[:9])] + [t * 4 for t in texts[:80]]
    df = samples(spark, [(i, t, "r", [], None) for i, t in enumerate(texts)]).localCheckpoint()
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() for k in [sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)] for s in (k.apply(i) for i in range(k.size()))}
    got, sent = [], []
    for size in (400, 40):
        monkeypatch.setattr(dedup, "ROWS", size)
        before, pairs = stages(), dedup.similar_pairs(df)
        got.append(sorted(map(tuple, pairs.collect())))
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        sent.append(sum(v for k, v in stages().items() if k not in before))
    assert got[0] == got[1] and (0, 500) in {x[:2] for x in got[0]}
    assert sent[1] < 1.6 * sent[0]
    assert "MapInArrow" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_keep_modes(spark):
    t = "one sentence that is long enough to be compared"
    df = samples(spark, [(0, t, "r", [], 0.2), (1, t + ".", "r", [], 0.9), (2, t + "..", "r", [], 0.9), (3, "other", "r", [], None)])
    kept = {k: sorted(r.idx for r in dedup.near_remove(df, keep=k).collect()) for k in ("first", "last", "best")}
    assert kept == {"first": [0, 3], "last": [2, 3], "best": [1, 3]}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 160)] + [(7, 7), (500, 500)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[k] == 0 for k in range(21)) and all(got[k] == 100 for k in range(100, 160)) and got[500] == 500
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_scores_stay_in_range_on_odd_rows(spark):
    rows = [(0, None, None), (1, "", ""), (2, "   ", " "), (3, "ALL CAPS", "x" * 30000), (4, "𝔘𝔫 why", "a b " * 10), (5, "1234", "...")]
    out = score.score(samples(spark, [(i, a, b, [], None) for i, a, b in rows])).collect()
    assert all(0 <= r[c] <= 1 for r in out for c in [*score.WEIGHTS, "overall"])
    none = score.thresholds(score.score(samples(spark, []))).first()
    assert (none.strict, none.moderate, none.lenient) == (0.8, 0.6, 0.4)


def test_validation_bounds(spark):
    rows = [(0, "x" * 9, "y" * 19), (1, "x" * 10, "y" * 20), (2, "x" * 5001, "y" * 10001), (3, None, " " * 30)]
    got = {r.idx: r.errors for r in validate.validate(samples(spark, [(i, a, b, [], None) for i, a, b in rows])).collect()}
    assert got[1] == [] and len(got[0]) == 2 and len(got[2]) == 2
    assert got[3] == ["Missing required field: instruction", "response is empty or whitespace-only"]
    stop = validate.summary(samples(spark, [(i, a, b, [], None) for i, a, b in rows[1:]]), stop_on_first_error=True).first()
    assert (stop.total, stop.invalid, stop.all_valid) == (2, 1, False)


def test_code_blocks(spark):
    df = spark.createDataFrame([("a ```py\nx = 1\n``` b ```y``` c ```\nz(",), ("none",)], "response string")
    blocks, warned = zip(*df.select(validate.code_blocks(F.col("response")), validate.code_warnings(F.col("response"))).collect(), strict=True)
    assert blocks == (["x = 1", "y", "z("], [])
    assert len(warned[0]) == 1 and warned[0][0].startswith("Code block 3") and warned[1] == ["No code blocks found in response"]


def test_truncation_never_exceeds_and_prefers_sentences(spark):
    t = "One sentence here. " * 10
    df = spark.createDataFrame([(t,), ("x" * 99,), ("word " * 30,), ("para\n\n" * 20,), ("short",), (None,)], "t string")
    got = [r[0] for r in df.select(repair.truncate(F.col("t"), 60)).collect()]
    assert got[0] == ("One sentence here. " * 3).rstrip() and got[1] == "x" * 60 and got[4:] == ["short", None]
    assert all(x is None or len(x) <= 60 for x in got)


def test_quality_bucket_is_pythons_rounding(spark):
    grid = [k * 0.005 for k in range(201)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in grid], "q double").select(query.bucket(F.col("q"))).collect()]
    assert got == [round(x, 1) for x in grid]


def test_filters(spark):
    df = samples(spark, [(0, "a", "b", ["x", "y"], 0.65), (1, "a", "b", [], None), (2, "a", "b", ["y"], 0.7)])
    ids = lambda d: sorted(r.idx for r in d.collect())
    assert ids(query.select(df, (0.7, None))) == [0, 2]  # 0.65 rounds to 0.7
    assert ids(query.select(df, (0.7, None), mode="exact")) == [2]
    assert ids(query.select(df, tags=["x", "y"], tag_mode="all")) == [0] and ids(query.select(df, tags=["y"])) == [0, 2]
    assert ids(query.select(df.limit(0), (0.1, None))) == []


def test_temporal_groups_with_gaps(spark):
    rows = [(0, "Same fact of some length", "2024-01-02T00:00:00", "g", 1), (1, " same fact OF some length", "2024-01-01T00:00:00", "g", 3), (2, "x", "bad", "h", None)]
    df = spark.createDataFrame(rows, "idx long, fact string, timestamp string, group_id string, variation_id int")
    got = {r.group_id: (r.sequential, r.duplicate_facts, r.chronological) for r in temporal.groups(df).collect()}
    assert got == {"g": (False, 2, False), "h": (False, 0, True)}
    errors = {r[0]: r[1] for r in df.select("idx", temporal.row_errors()).collect()}
    assert errors[0] == [] and len(errors[2]) == 3


def test_readers_and_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"instruction": "i1", "response": "r1"}\n\nbroken {\n{"question": "i2", "answer": "r2"}\n{"question": "i3"}\n')
    got = sorted((r.instruction, r.response, r.source_line) for r in files.load(spark, f"{tmp_path}/a.jsonl").collect())
    assert got == [("i1", "r1", 1), ("i2", "r2", 4)]
    (tmp_path / "b.json").write_text(json.dumps({"data": [{"input": "i", "output": "r"}, {"input": "", "output": "r"}]}))
    assert [(r.instruction, r.response) for r in files.load(spark, f"{tmp_path}/b.json").collect()] == [("i", "r")]
    (tmp_path / "c.csv").write_text('instruction,response\n"a ""b""","x\ny"\n,z\n')
    assert [(r.instruction, r.response, r.source_line) for r in files.load(spark, f"{tmp_path}/c.csv").collect()] == [('a "b"', "x\ny", 2)]
    (tmp_path / "d.txt").write_text("INSTRUCTION:\ndo\nRESPONSE:\ndone\nEND\nnoise\nINSTRUCTION:\nno answer\nEND\n")
    assert [(r.instruction, r.response) for r in files.load(spark, f"{tmp_path}/d.txt").collect()] == [("do", "done")]


def test_hub_records(spark):
    schema = "text string, label int, messages array<struct<role:string,content:string>>"
    rows = [("t", 0, None), ("t", 3, None), (None, None, [("system", "s"), ("user", "u1"), ("assistant", "a"), ("user", "u2")]), (None, None, [("user", "u")])]
    got = sorted((r.instruction, r.response) for r in records.to_samples(spark.createDataFrame(rows, schema), hub=True).collect())
    assert got == [("t", "3"), ("u1\n\nu2", "a")]


def test_store_round_trips(spark, tmp_path):
    df = samples(spark, [(0, 'a "q", b', "line\nline", ["x", "y,z"], 0.5), (1, "", None, [], None)])
    store = Store(spark, str(tmp_path))
    for f in ("jsonl", "json", "csv", "parquet"):
        store.save(df, f"n_{f}", f, {"k": 1})
        assert sorted(store.load(f"n_{f}").collect()) == sorted(df.collect()), f
    made = store.catalog()["n_csv"]["created_at"]
    store.update(store.load("n_csv").where("idx = 0"), "n_csv")
    entry = store.catalog()["n_csv"]
    assert (entry["sample_count"], entry["created_at"], entry["custom_metadata"]) == (1, made, {"k": 1})
    store.delete("n_json")
    assert sorted(store.catalog()) == ["n_csv", "n_jsonl", "n_parquet"]


def test_pipeline_and_undo(spark):
    p = pipeline.Pipeline(spark, {"operations": [{"type": "validate"}, {"type": "deduplicate"}, {"type": "quality"}]})
    p.samples = samples(spark, [(0, "What is this thing?", "An answer that is long enough.", [], None), (1, "What is this thing?", "Another answer, long enough.", [], None), (2, "x", "y", [], None)])
    assert [r.idx for r in p.run().collect()] == [0]
    p.undo()
    p.undo()
    assert p.samples.count() == 2
    edits = spark.createDataFrame([(0, "approve", None, None), (1, "edit", "new", None), (2, "delete", None, None)], "idx long, action string, instruction string, response string")
    out = {r.idx: (r.review_status, r.instruction) for r in pipeline.reviewed(samples(spark, [(i, "old", "r", [], None) for i in range(4)]), edits).collect()}
    assert out == {0: ("approved", "old"), 1: ("pending", "new"), 3: ("pending", "old")}


def test_generation_with_the_stub(spark):
    seeds = spark.createDataFrame([("seed one",), ("seed two",)], "instruction string")
    assert generate.self_instruct(seeds, generate.EchoGenerator, per_seed=3, target=5).count() == 5
    assert generate.evolve(seeds, generate.EchoGenerator).count() == 2
    docs = spark.createDataFrame([("document",)], "text string")
    assert generate.ask_about(docs, generate.EchoGenerator, questions=4).count() == 4
    assert "<think>" in generate.reason(seeds, generate.EchoGenerator).first().response
    got = spark.createDataFrame([('```json\n{"all_consistent": true}\n```',), ("no",)], "t string").select(generate.verdict(F.col("t")).alias("v")).collect()
    assert got[0].v.all_consistent and (got[1].v is None or got[1].v.all_consistent is None)


def test_html():
    assert clean("<p>a&amp;b <code>x</code></p><script>no</script>\n\n<p> c </p>") == "a&b ```\nx\n```\nc"
    assert clean(None) == "" and clean("<p>open <b>text") == "open text"


def test_config_layers():
    c = Config({"dev": {"extends": "base", "llm": {"timeout": 5}}, "base": {"llm": {"timeout": 1, "top_p": 0.5}}}, "dev", {"x": 1}, {"QM_STORAGE__BASE_PATH": "/d"})
    assert (c.get("llm.timeout"), c.get("llm.top_p"), c.get("x"), c.get("storage.base_path"), c.get("no.such", 7)) == (5, 0.5, 1, "/d", 7)


def test_code_of_any_depth(spark):
    """Code that the parser gives up on has a message, and the job goes on."""
    deep = ["(" * 5000 + ")" * 5000, "-" * 200_000 + "1", "[" * 90 + "]" * 90, "x = " + "+".join(["1"] * 100_000), "def f(:", "ok = 1"]
    df = spark.createDataFrame([(k, f"```py\n{c}\n```") for k, c in enumerate(deep)], "idx int, response string")
    got = {r.idx: len(r.w) for r in df.select("idx", validate.code_warnings(F.col("response")).alias("w")).collect()}
    assert got[0] == got[1] == got[4] == 1 and got[2] == got[5] == 0 and len(got) == 6


def test_config_files(tmp_path):
    for name, text in (("a.json", '{"llm": {"timeout": 5}}'), ("a.yaml", "llm:\n  timeout: 5\n")):
        (tmp_path / name).write_text(text)
        c = Config(user=str(tmp_path / name), environ={"QM_LLM__TOP_P": "0.5"})
        assert c.get("llm.timeout") == 5 and c.get("llm.top_p") == 0.5 and c.get("storage.base_path") == "datasets"
        c.save(str(tmp_path / f"saved-{name}"))
        assert Config(user=str(tmp_path / f"saved-{name}"), environ={}).data == c.data
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "list.yaml").write_text("- 1\n")
    for name in ("bad.json", "list.yaml", "none.yaml"):
        assert Config(user=str(tmp_path / name), environ={}).data == Config(environ={}).data


def test_store_statistics(spark, tmp_path):
    rows = [("i", "r", "a", ["x", "y"], 0.5, "approved"), ("i", "r", "a", ["x"], 1.0, "pending"), ("i", "r", "b", None, None, "pending")]
    df = spark.createDataFrame(rows, "instruction string, response string, source_type string, tags array<string>, quality_score double, review_status string")
    store = Store(spark, f"file://{tmp_path}")
    got = store.save(df, "s")["statistics"]
    assert got == {"source_types": {"a": 2, "b": 1}, "tags": {"x": 2, "y": 1}, "review_statuses": {"approved": 1, "pending": 2}, "quality_statistics": {"mean": 0.75, "std": 0.25, "min": 0.5, "max": 1.0}}
    assert store.save(df.limit(0), "e")["statistics"] == {} and store.catalog()["s"]["statistics"] == got


def test_self_instruct_without_seeds(spark):
    got = generate.self_instruct(None, generate.EchoGenerator, per_seed=2, target=1000).collect()
    assert {r.seed for r in got} == set(generate.SEEDS) and got[0].tags == ["self_instruct"] and got[0].source_type == "generated"
    assert {json.loads(r.custom_json)["generation_index"] for r in got} == {0, 1} and all(json.loads(r.custom_json)["seed_task"] == r.seed for r in got)


def test_hub_splits(spark, tmp_path):
    for part, n in (("train-0", 3), ("train-1", 2), ("test-0", 1)):
        rows = [{"prompt": f"{part}-{k}", "target": "t" if k != 1 else None, "tags": ["g"], "license": "MIT"} for k in range(n)]
        (tmp_path / "d" / "en").mkdir(parents=True, exist_ok=True)
        (tmp_path / "d" / "en" / f"{part}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = sorted((r.id, r.instruction, r.source_url.endswith("/d"), r.tags, r.license, r.author) for r in files.load_hub(spark, str(tmp_path), "d", subset="en").collect())
    assert got == [(f"d_{k}", i, True, ["g"], "MIT", None) for k, i in ((0, "train-0-0"), (2, "train-0-2"), (3, "train-1-0"))]
    assert files.load_hub(spark, str(tmp_path), "d", "test", "en").count() == 1


def test_components_broadcast_nothing(spark, monkeypatch):
    plans, put = [], importlib.import_module("quillmill.operators.components")
    monkeypatch.setattr(put, "written", lambda df, path, f=put.written: (plans.append(df._jdf.queryExecution().executedPlan().toString()), f(df, path))[1])
    found = components(spark.range(60).selectExpr("id AS src", "id + 1 AS dst"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {r.component for r in found.collect()} == {0}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_near_queries_leave_whole_texts_where_they_are(spark, tmp_path):
    """Without broadcasts, what is shuffled are first lines: 300 lines of 40 characters before texts of 6,000."""
    letters, n = random.Random(5), 300
    docs = [(i, "".join(letters.choices("abcdefgh ", k=40)) + "\n" + "".join(letters.choices("abcdefghijklmnop", k=6000)), "en", "s", 6041) for i in range(n)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(n)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sc = spark.sparkContext
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() for k in [sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)] for s in (k.apply(i) for i in range(k.size()))}
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for c in names:
            spark.conf.set(c, "-1")
        for name in ("near_pairs", "near_flag", "near_remove_best"):
            before = stages()
            queries.QUERIES[name](spark, str(tmp_path)).collect()
            sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
            assert 0 < sum(v for k, v in stages().items() if k not in before) < 1000 * n, name
    finally:
        for c in names:
            spark.conf.unset(c)
