"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillmill.llm import ann, bpe, exact_dedup, near_dup, packing, quality, sharding, toxicity, url_filter, warc
from quillmill.plans.scratch import scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, keep string, digest string, shard int, __row int"
LONG = "a long text of words. " * 20000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one two three four five six seven", "en"), (2, None, None), (3, "", "en"), (4, LONG, "en"), (5, "one two three four five six seven", "en")]
    rows += [(6, "short", "de"), (6, "short", "de"), (None, "one two three four five six seven", None), (7, " \n\t ", "en"), (8, "é😀 ünï 中文", "fr")]
    return spark.createDataFrame([(i, t, g, "s", None if t is None else len(t), 0.1, "k", "d", 3, 4) for i, t, g in rows], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, 1, None), (6, None, 1), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_toxicity(docs, labels):
    m = toxicity.train(docs, labels, F.lit(True))
    out = toxicity.score(docs, m).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    empty = toxicity.train(docs.limit(0), labels, F.lit(True))
    assert toxicity.score(docs.limit(0), empty).collect() == [] and empty.score(toxicity.terms(None)) < 1e-6
    assert toxicity.keep_clean(docs, empty).count() == docs.count()


def test_sharding(docs):
    out = sharding.shard(docs).collect()
    n = docs.count()
    assert sorted(r.row for r in out) == list(range(n))
    assert sorted((r.shard, r.slot) for r in out) == sorted((p % 16, p // 16) for p in range(n))
    assert [r.size for r in out if r.doc_id == 2] == [1]
    assert sharding.shard(docs.limit(0)).count() == 0


def test_packing(docs):
    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    out = packing.pack(docs, path, pattern).collect()
    of, seqs = {}, {}
    for r in out:
        of.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for ps in seqs.values():
        ps.sort(key=lambda r: r.offset)
        at = 0
        for p in ps:
            assert p.offset == at and len(p.ids) == 4 * p.length
            at += p.length
        assert at <= 2048
    assert sum(r.length for r in out) == sum(sum(p.length for p in ps) for ps in of.values())
    assert [r.doc_tokens for r in out if r.doc_id in (2, 3)] == [1, 1]
    assert packing.pack(docs.limit(0), path, pattern).count() == 0


def test_url_filter(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "no scheme", "x"), (3, "http://A.Example.ORG/es/1?q", "x"), (3, "http://A.Example.ORG/es/1?q", "x"), (4, "http://org", "x"), (5, "https://notexample.org/es/", "x")], "page_id long, url string, key string")
    listed = spark.createDataFrame(url_filter.RULES + [(None, None, "block")], "host string, path string, verdict string")
    got = rows(url_filter.judge(pages, listed).select("page_id", "host", "path", "rule", "verdict"))
    assert got == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.org", "/es/1", "example.org/es/", "block"), (3, "a.example.org", "/es/1", "example.org/es/", "block"),
        (4, "org", "", None, "allow"), (5, "notexample.org", "/es/", "org/", "allow"),
    ]
    assert {r.verdict for r in url_filter.judge(pages, listed.limit(0), default="block").collect()} == {"block"}
    assert url_filter.judge(pages.limit(0), listed).count() == 0


def test_warc(spark):
    big = "p" * 1500
    pages = spark.createDataFrame([(1, "u", big, 1), (2, None, big, 1), (2, None, big, 1), (3, "u\nv", None, 1), (4, "u", "s", 1), (5, "u", "s", 1), (None, "u", big, 1)], "page_id long, url string, html string, shard int")
    folder = scratch(spark, "warc-test")
    manifest = warc.write(pages, folder, roll=600)
    assert manifest.agg(F.sum("records")).first()[0] == 7 and manifest.count() > 1
    got = rows(warc.read(spark, folder).select("record_id", "payload_bytes", "record_type", "refers_to", "payload"))
    b = big.encode()
    want = [(1, 1500, "revisit", 2, b""), (2, 1500, "response", None, b), (2, 1500, "response", None, b), (3, 0, "response", None, b""), (4, 1, "response", None, b"s"), (5, 1, "response", None, b"s"), (None, 1500, "revisit", 2, b"")]
    assert [(a, n, k, r, bytes(p)) for a, n, k, r, p in got] == sorted(want, key=str)
    again = scratch(spark, "warc-test")
    assert rows(warc.write(pages, again, roll=600)) == rows(manifest)  # the same bytes
    empty = scratch(spark, "warc-test")
    assert warc.write(pages.limit(0), empty).count() == 0 and warc.read(spark, empty).count() == 0


def test_quality(docs, labels):
    out = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    none = quality.train(docs.limit(0), labels)
    assert quality.keep_good(docs, none).count() == docs.count()
    assert quality.score(docs.limit(0), none).count() == 0


def test_near_dup(docs):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dup.groups(docs).collect()}
    assert got[1, 3] == (1, True) and got[5, 3] == (1, False) and got[None, 3] == (None, True)
    assert got[2, 0] == (2, True) and got[3, 0] == (3, True) and got[7, 0] == (7, True) and got[6, 1] == (6, True)
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert near_dup.groups(docs.limit(0)).count() == 0


def test_ann(spark):
    nan, inf = float("nan"), float("inf")
    vs = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vs], "vec_id long, embedding array<float>, rank int")
    got = rows(ann.search(df, df))
    assert got == sorted([(0, 1, 1, 1.0), (0, 2, 2, 0.0), (1, 1, 0, 1.0), (1, 2, 2, 0.0), (2, 1, 0, 0.0), (2, 2, 1, 0.0)], key=str)
    assert ann.search(df.limit(0), df).count() == 0 and ann.search(df, df.limit(0)).count() == 0


def test_ann_of_many_copies(spark):
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.when(F.col("id") < 290, 2.0).otherwise(F.col("id"))).alias("embedding"))
    got = [r.vec_id for r in ann.search(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [1, 2, 3, 4, 5]


def test_bpe(docs):
    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    back = {(r.doc_id, r.decoded) for r in out.collect()}
    assert back == {(r.doc_id, r.text or "") for r in docs.collect()}
    assert bpe.encode_decode(docs.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_exact_dedup(spark, docs):
    folder = scratch(spark, "dedup-test")
    docs.write.parquet(folder)
    out = exact_dedup.dedup(spark, folder).collect()
    got = {(r.doc_id, r.text_sha256[:6]): (r.keep_id, r.group_size, r.kept) for r in out}
    by = {k[0]: v for k, v in got.items()}
    assert by[1] == (5, 3, False) and by[5] == (5, 3, True) and by[None] == (5, 3, False) and by[2] == (3, 2, False) and by[3] == (3, 2, True) and by[6] == (6, 2, True)
    assert sum(r.first for r in out) == len({r.text_sha256 for r in out})
    kept = exact_dedup.keep_first(spark, docs)
    assert kept.columns == docs.columns and kept.count() == len({r.text_sha256 for r in out})
    assert exact_dedup.keep_first(spark, docs.limit(0)).count() == 0


def test_exact_dedup_state_goes_on(spark):
    folder, state = scratch(spark, "dedup-test"), scratch(spark, "dedup-state")
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(folder)
    exact_dedup.dedup(spark, folder, state=state)
    spark.createDataFrame([(3, "a"), (0, "c")], "doc_id long, text string").write.mode("append").parquet(folder)
    got = rows(exact_dedup.dedup(spark, folder, state=state).select("doc_id", "keep_id", "group_size"))
    assert got == [(0, 0, 1), (1, 3, 2), (2, 2, 1), (3, 3, 2)]


def test_pipeline_stages(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    base.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, base, str(tmp_path)).schema.names == base.columns, name
        assert stage(spark, base.limit(0), str(tmp_path)).count() == 0, name
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {3, 4, 5, 6, 7, 8}


def test_pipeline_on_clashing_columns_and_an_empty_table(spark, docs, tmp_path):
    """Stages keep extra columns, whatever their names; all five run on no rows."""
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    named = docs.withColumns({c: F.lit(1) for c in ("id", "label", "rep", "node", "star", "n", "half", "file", "at")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, named, str(tmp_path))
        assert out.schema.names == named.columns, name
        assert 0 < out.count() <= named.count(), name
    docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
