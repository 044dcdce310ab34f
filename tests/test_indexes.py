"""Medians by ranges and sketches, the text index, counts, writers and registries."""

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quillmill.operators import facts, score, textindex
from quillmill.plans import pipeline
from quillmill.sources import files


def test_medians(spark, monkeypatch):
    rng = random.Random(3)
    cases = [[0.5], [0.1, 0.9], [0.2] * 7, [0.1, 0.1, 0.9, 0.9], [rng.random() for _ in range(999)], [rng.random() ** 9 for _ in range(1000)], [rng.choice([0.3, 0.30000000000000004, 0.7]) for _ in range(50)], [-5.0, 1e9, 3.0, 3.5]]
    for bins in (2, 1024):
        monkeypatch.setattr(score, "BINS", bins)
        for values in cases:
            df = spark.createDataFrame([(v,) for v in values] + [(None,)], "q double")
            assert score.median(df, "q") == statistics.median(values)
            assert score.thresholds(df, "q").first().median == statistics.median(values)
    none = spark.createDataFrame([(None,)], "q double")
    for mode in ("exact", "sketch"):
        assert tuple(score.thresholds(none, "q", mode).first())[:3] == (0.8, 0.6, 0.4) and score.thresholds(none, "q", mode).first().median is None
    with pytest.raises(ValueError):
        score.thresholds(none, "q", "other")


def test_sketched_median(spark):
    df = spark.range(200_000).select((F.xxhash64("id").cast("double") ** 3).alias("q"))
    got = score.thresholds(df, "q", "sketch").first().median
    below = df.where(F.col("q") <= got).count()
    assert abs(below / 200_000 - 0.5) <= score.RANK_ERROR


def test_a_search_skips_files(spark, tmp_path):
    words = ["alpha beta", "gamma Delta", "épsilon ζeta", ""]
    rows = [(k, words[k % 4] if k % 4 < 3 else None, f"text {words[k // 250]} number {k}" + " filler" * (400 if k == 600 else 0) + (" needleX" if k == 600 else "")) for k in range(1000)]
    spark.createDataFrame(rows, "idx long, instruction string, response string").repartitionByRange(10, "idx").write.parquet(f"{tmp_path}/t")
    textindex.build(spark, f"{tmp_path}/t", f"{tmp_path}/i")
    whole = spark.read.parquet(f"{tmp_path}/t")

    def check(needle, fields=("instruction", "response"), case=False):
        df, read, total = textindex.search(spark, f"{tmp_path}/t", f"{tmp_path}/i", needle, fields, case)
        low = (lambda x: x or "") if case else (lambda x: (x or "").lower())
        assert sorted(r.idx for r in df.collect()) == [r.idx for r in whole.orderBy("idx").collect() if any(low(needle) in low(r[f]) for f in fields)]
        assert total == 10
        return read

    assert check("NEEDLEx") == 1 and check("needleX", case=True) == 1 and check("number 77") <= 3 and check("no such thing") == 0
    assert check("a") == 10 and check("") == 10 and check("ζeta") == 10 and check("text gamma", ("response",)) < 6


def test_counts(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"instruction": "i", "response": "r"}\n\n{"instruction": "i"}\n')
    assert files.count(spark, f"{tmp_path}/a.jsonl") == 1 and files.count(spark, f"{tmp_path}/none.jsonl") is None
    spark.range(7).write.parquet(f"{tmp_path}/hub/d/train-0.parquet")
    (tmp_path / "hub" / "d" / "test.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    base = f"{tmp_path}/hub"
    assert files.count_hub(spark, base, "d") == 7 and files.count_hub(spark, base, "d", "test") == 2
    assert files.count_hub(spark, base, "d", streaming=True) is None and files.count_hub(spark, base, "d", "none") is None


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "x", y', None), (2, "a\nb", 0.5)], "id long, text string, value double").coalesce(1)
    for kind in ("jsonl", "json", "csv"):
        files.write_records(df, f"{tmp_path}/{kind}", kind)
    (part,) = (tmp_path / "json").glob("part-*")
    assert json.loads(part.read_text()) == [{"id": 1, "text": 'say "x", y', "value": None}, {"id": 2, "text": "a\nb", "value": 0.5}]
    (part,) = (tmp_path / "jsonl").glob("part-*")
    assert [json.loads(x)["id"] for x in part.read_text().splitlines()] == [1, 2]
    assert [r.text for r in files.read_csv(spark, f"{tmp_path}/csv").orderBy("id").collect()] == ['say "x", y', "a\nb"]
    files.write_records(df.where("id > rand() + 9"), f"{tmp_path}/empty", "json")
    assert {r.value for r in spark.read.text(f"{tmp_path}/empty").collect()} <= {"[]"}
    with pytest.raises(ValueError):
        files.write_records(df, f"{tmp_path}/x", "xml")


def test_registries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "READERS", dict(files.READERS))
    monkeypatch.setattr(files, "SUFFIXES", dict(files.SUFFIXES))
    files.register("pipe", (".PSV",), lambda s, paths: s.read.text(paths).select(F.split("value", r"\|")[0].alias("question"), F.split("value", r"\|")[1].alias("answer"), F.col("_metadata.file_path").alias("source_file")))
    (tmp_path / "a.psv").write_text("q|a\n")
    assert [(r.instruction, r.response) for r in files.load(spark, f"{tmp_path}/*").collect()] == [("q", "a")]
    monkeypatch.setitem(pipeline.OPERATIONS, "shout", lambda df, c: df.withColumn("instruction", F.concat(F.upper("instruction"), F.lit(c["end"]))))
    p = pipeline.Pipeline(spark, {"operations": [{"type": "source", "config": {"path": f"{tmp_path}/*"}}, {"type": "shout", "config": {"end": "!"}}]})
    assert p.run().first().instruction == "Q!"
    monkeypatch.setitem(pipeline.STRATEGIES, "mirror", lambda df, make, **o: df.select(F.col("response").alias("instruction"), F.col("instruction").alias("response")))
    p = pipeline.Pipeline(spark, {"operations": [{"type": "source", "config": {"path": f"{tmp_path}/*"}}, {"type": "generate", "config": {"strategy": "mirror", "url": "none"}}]})
    assert sorted(r.instruction for r in p.run().collect()) == ["a", "q"]
    assert set(facts.GUIDANCE) == set(facts.DOMAINS)
    with pytest.raises(ValueError):
        facts.stories(spark, None, domain="none")


def test_text_index_makes_a_bitmap_in_the_task_that_reads_a_file(spark, tmp_path, monkeypatch):
    """Filters leave a task as bitmaps: a row for each file and bucket at most, not one for each trigram."""
    rows = [(i, f"{chr(97 + i % 26)}É\u0130 {i * 7919} \U0001f600ß", "" if i % 3 else None) for i in range(3000)]
    spark.createDataFrame(rows, "idx long, instruction string, response string").repartitionByRange(3, "idx").write.parquet(f"{tmp_path}/t")
    aggregated, agg = [], textindex.F.bitmap_or_agg
    monkeypatch.setattr(textindex.F, "bitmap_or_agg", lambda c: (aggregated.append(c), agg(c))[1])
    index = textindex.build(spark, f"{tmp_path}/t", f"{tmp_path}/i")
    assert aggregated and 3 <= index.count() <= 3 * textindex.BITS // 32768
    for needle in ("7919 \U0001f600", "aé", "É\u0130 23757 ", "\U0001f600ß", "i\u0307 0", "nothing"):
        df, read, total = textindex.search(spark, f"{tmp_path}/t", f"{tmp_path}/i", needle)
        plain = textindex.find_by_text(spark.read.parquet(f"{tmp_path}/t"), needle, ("instruction", "response"), False)
        assert sorted(r.idx for r in df.collect()) == sorted(r.idx for r in plain.collect()) and read <= total == 3
