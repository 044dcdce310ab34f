"""Readers whose line numbers must survive splits, prompt lists and document folders."""

import csv
import io
import json
import random

import pytest

from quillmill.sources import csv_records, files, records


def test_line_numbers_over_splits(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 7)):
        rows = [json.dumps({"instruction": f"{name}{k}", "response": "r" * (k % 50)}) if k % 5 else ("" if k % 2 else "{bad") for k in range(1, n + 1)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = files.read_jsonl(spark, f"{tmp_path}/*.jsonl")
        assert spark.read.text(f"{tmp_path}/*.jsonl").rdd.getNumPartitions() > 5
        got = {(r.source_file[-7:-6], r.source_line): r.instruction for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(f, k): f"{f}{k}" for f, n in (("a", 3000), ("b", 7)) for k in range(1, n + 1) if k % 5}


def test_prompts(spark, tmp_path):
    def read(name, text):
        (tmp_path / name).write_text(text)
        return [r.instruction for r in files.read_prompts(spark, str(tmp_path / name)).orderBy("source_line").collect()]

    assert read("a.json", json.dumps(["one", {"prompt": "two"}, {"other": 1}, {"instruction": "", "text": " three "}, None, 4])) == ["one", "two", "three"]
    assert read("a.jsonl", '{"question": "q"}\n\n{bad\n"bare"\n') == ["q", "bare"]
    assert read("a.txt", 'first line\n\n  second "line"\n') == ["first line", 'second "line"']


def test_documents(spark, tmp_path):
    for n in ("a.txt", "b.md", "c.csv"):
        (tmp_path / n).write_text(f"{n}\nbody")
    assert sorted(r.text for r in files.read_documents(spark, str(tmp_path)).collect()) == ["a.txt\nbody", "b.md\nbody"]
    assert files.read_documents(spark, str(tmp_path / "b.md")).first().text == "b.md\nbody"


def test_codec(spark):
    cols = "id string, instruction string, response string, source_type string, tags array<string>, quality_score double, custom_json string"
    rows = [
        ("x", 'say "hi"', "a\nb", "s", ["t", "u"], 0.5, '{"group_id": "g", "n": {"k": [1, 2.5]}}'),
        ("", "é😀", "r", None, None, None, "{}"),
        (None, "i", "r", None, [], None, "not json"),
        (None, "i", "r", None, None, None, '{"only": null}'),
    ]
    lines = records.encode(spark.createDataFrame(rows, cols)).cache()
    said = [json.loads(r.line) for r in lines.collect()]
    assert said[0] == {"id": "x", "instruction": 'say "hi"', "response": "a\nb", "metadata": {"source_type": "s", "tags": ["t", "u"], "quality_score": 0.5, "group_id": "g", "n": {"k": [1, 2.5]}}}
    assert said[1] == {"instruction": "é😀", "response": "r", "metadata": {}} and said[2]["metadata"] == {"tags": []} and said[3]["metadata"] == {"only": None}
    back = records.decode(lines.union(spark.createDataFrame([("{bad",), ("[1]",), ("7",)], "line string"))).collect()
    assert [(r.id, r.instruction, r.tags, r.quality_score) for r in back] == [("x", 'say "hi"', ["t", "u"], 0.5), (None, "é😀", None, None), (None, "i", [], None), (None, "i", None, None)]
    assert json.loads(back[0].custom_json) == {"group_id": "g", "n": {"k": [1, 2.5]}} and back[1].custom_json is None


def test_each_json_file_by_its_own_shape(spark, tmp_path, caplog):
    texts = {
        "list": '\n [{"question": "a", "output": "1", "data": [1, 2]}, 7, "x", null, {"question": "b", "output": "2", "data": "text"}]',
        "data": '{"data": [{"question": "c", "output": "3", "n": 1.5}], "samples": [{"question": "no", "output": "no"}]}',
        "samples": '{"samples": [{"question": "d", "output": "4"}, {"question": "e", "output": {"k": [1]}}]}',
        "examples": '{"x": 1, "examples": [{"question": "f", "output": "6"}]}',
        "one": '{"question": "g", "output": "7"}',
        "null": '{"data": null}',
        "scalar": "7",
        "bad": '{"question": "h", "output": ',
        "cut": '[{"question": "i", "output": "9"}, {"que',
        "empty": "",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "a.docx").write_text("x")
    with caplog.at_level("WARNING", "quillmill.sources"):
        got = files.load(spark, [f"{tmp_path}/*.json", f"{tmp_path}/*.jsonl", f"{tmp_path}/a.docx"]).collect()
    found = {(r.source_file.rsplit("/", 1)[1][:-5], r.source_line): (r.instruction, r.response) for r in got}
    assert {k: v for k, v in found.items() if k[0] != "cut"} == {
        ("list", 1): ("a", "1"), ("list", 5): ("b", "2"), ("data", 1): ("c", "3"), ("samples", 1): ("d", "4"), ("samples", 2): ("e", '{"k":[1]}'),
        ("examples", 1): ("f", "6"), ("one", 1): ("g", "7"),
    }
    said = " ".join(r.getMessage() for r in caplog.records)
    assert "hold no JSON records" in said and "no file matches" in said and "no reader" in said
    assert {r.data for r in got if r.data} == {"[1,2]", "text"}
    assert files.read_json(spark, f"{tmp_path}/scalar.json").count() == 0
    rejects = files.scan(spark, [f"{tmp_path}/*.json", f"{tmp_path}/a.docx"])[1].collect()
    assert {r.source_file.rsplit("/", 1)[1] for r in rejects} >= {"a.docx", "null.json", "scalar.json", "bad.json"}


def test_a_corrupt_file_is_left_out(spark, tmp_path):
    spark.createDataFrame([("i", "r")], "instruction string, response string").coalesce(1).write.parquet(f"{tmp_path}/a.parquet")
    (next((tmp_path / "a.parquet").glob("*.parquet")).parent / "c.parquet").write_bytes(b"PAR1 not really")
    (tmp_path / "b.parquet").write_bytes(b"PAR1 not really")
    assert [r.instruction for r in files.load(spark, [f"{tmp_path}/b.parquet", f"{tmp_path}/a.parquet"]).collect()] == ["i"]


def pairs(df):
    return sorted((r.instruction, r.response) for r in df.collect())


def test_paths_without_files(spark, tmp_path, caplog):
    (tmp_path / "a.txt").write_text("plain text")
    with pytest.raises(FileNotFoundError):
        files.load(spark, [f"{tmp_path}/a.txt", f"{tmp_path}/b.txt"])
    with pytest.raises(ValueError):
        files.load(spark, f"{tmp_path}/*.csv")
    with pytest.raises(ValueError):
        files.load(spark, [])
    with caplog.at_level("WARNING", "quillmill.sources"):
        assert files.load(spark, [f"{tmp_path}/*.csv", f"{tmp_path}/a.txt"]).count() == 0
    assert "no file matches" in caplog.text


def test_each_file_by_its_own_suffix_and_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("instruction,response\nI1,R1\n")
    (tmp_path / "U.CSV").write_text("response,instruction,extra\nR2,I2,x\n\nR3,I3,\n")
    (tmp_path / "q.csv").write_text('\ufeffquestion,answer,answer\r\n"I ""4"", a","R\r\n4",no\r\n')
    (tmp_path / "long.csv").write_text("instruction,response\nI,R\nI,R,more\n")
    (tmp_path / "odd[1]{x}.Csv").write_text("input,output\nI5,R5")
    (tmp_path / "l.JSONL").write_text('{"query": "I6", "completion": "R6"}\n')
    (tmp_path / "n.xyz").write_text("I7")
    (tmp_path / "s.txt").write_text("x === INSTRUCTION ===\nI8\n=== RESPONSE ===\n R8 \n=== END ===\n=== INSTRUCTION ===\nI9\n=== END ===\n\n=== INSTRUCTION ===I10=== RESPONSE ===R10")
    got, rejects = files.scan(spark, f"{tmp_path}/*")
    assert pairs(got) == sorted([("I1", "R1"), ("I2", "R2"), ("I3", "R3"), ('I "4", a', "R\n4"), ("I5", "R5"), ("I6", "R6"), ("x \nI8".strip(), "R8"), ("I10", "R10")])
    assert {(r.instruction, r.source_line) for r in got.collect()} >= {("I2", 2), ("I3", 3), ("I5", 2), ("I6", 1), ("I10", None)}
    assert {r.extra for r in got.collect()} == {"x", None} and {r["answer.1"] for r in got.collect()} == {"no", None}
    assert sorted((r.source_file.rsplit("/", 1)[1], r.reason.split()[0]) for r in rejects.collect()) == [("long.csv", "a"), ("n.xyz", "no")]


def test_parquet_files_of_other_types(spark, tmp_path):
    for k, kind in enumerate(("int", "string", "int", "array<int>")):
        value = {"int": 7, "string": "seven", "array<int>": [7]}[kind]
        spark.createDataFrame([(f"i{k}", f"r{k}", value)], f"{'instruction' if k else 'question'} string, response string, k {kind}").coalesce(1).write.parquet(f"{tmp_path}/{k}.parquet")
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 not really")
    got, rejects = files.scan(spark, f"{tmp_path}/*.parquet")
    assert sorted((r.instruction, r.response, r.k) for r in got.collect()) == [("i0", "r0", "7"), ("i1", "r1", "seven"), ("i2", "r2", "7"), ("i3", "r3", "[7]")]
    assert [r.source_file.rsplit("/", 1)[1] for r in rejects.collect()] == ["bad.parquet"]
    assert len(files.parquet_groups(spark, [p for k in range(4) for p in files._listed(spark, f"{tmp_path}/{k}.parquet")])[0]) == 4


def test_csv_records_over_splits(spark, tmp_path):
    rng, want = random.Random(4), {}
    for name in ("a", "b", "c"):
        rows = [["instruction", "response", "n"]]
        for k in range(400):
            cell = lambda: "".join(rng.choice(["x", "y ", '"', '""', ",", "\n", "\n\n", "é", "'"]) for _ in range(rng.randrange(0, 12)))
            rows.append([f"{name}{k}" + cell(), cell(), str(k)])
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator="\r\n" if name == "b" else "\n").writerows(rows)
        (tmp_path / f"{name}.csv").write_bytes(out.getvalue().encode())
        want |= {(name, k): [c or None for c in r] for k, r in enumerate(rows, 1)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = {(r.source_file[-5], r.record): r.cells for r in csv_records.records(spark, [f"{tmp_path}/{n}.csv" for n in "abc"]).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "h.csv").write_text("instruction,response\n")
    (tmp_path / "stray.csv").write_text('instruction,response\n5" pipe,a "word" b\n"open to the end,\nof the file\n')
    assert pairs(files.read_csv(spark, [f"{tmp_path}/{n}.csv" for n in ("e", "h", "stray")])) == [('5" pipe', 'a "word" b'), ("open to the end,\nof the file", None)]


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"g={k}").mkdir()
        (tmp_path / f"g={k}" / "a.jsonl").write_text(f'\n{{"query": "q{k}"}}\n', encoding="utf-8")
    before = spark.conf.get(files.LISTING)
    files.TASKS, tasks = 3, files.TASKS
    spark.sparkContext.setJobGroup("folders", "listing")
    try:
        rows = files.read_jsonl(spark, f"{tmp_path}/g=*").collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        files.TASKS = tasks
    assert {(r.query, r.source_line) for r in rows} == {(f"q{k}", 2) for k in range(40)}
    told = spark.sparkContext.statusTracker()
    stages = [told.getStageInfo(x) for j in told.getJobIdsForGroup("folders") for x in told.getJobInfo(j).stageIds]
    assert stages and max(x.numTasks for x in stages if x) < 40 and spark.conf.get(files.LISTING) == before


def test_an_export_has_more_files_with_more_text(spark, tmp_path, monkeypatch):
    from quillmill.plans import round_trips

    spark.range(900).selectExpr("899 - id AS doc_id", "'en' AS lang", "repeat(cast(id AS string), 50) AS text", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(round_trips, "FILE_BYTES", 10_000)
    monkeypatch.setattr(round_trips, "scratch", lambda s, tag: f"{tmp_path}/{tag}")
    rows = round_trips._hub_export(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.idx) for r in rows} == {(k, k) for k in range(900)} and len(rows) == 900
    assert len(list(tmp_path.glob("hub/corpus/en/train-parts.parquet/part-*"))) >= 13
