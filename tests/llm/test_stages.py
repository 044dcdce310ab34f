"""Scores recomputed plainly, digests that clash, and the pipeline's stages against the same decisions made one by one."""

import math

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from quillmill.llm import common, exact_dedup, near_dup, packing, quality, toxicity

SF = "/root/testdata/sf0.01"


def plain_score(model, text, source, lang, n_chars):
    """The quality score of a row from the model's numbers, without arrays."""
    v = model.views
    measures, terms = quality.features(text)
    meta = quality.metadata(source, lang, n_chars)
    said = sum((v.odds[0][t] + v.odds[1][t]) / 2 for t in terms) / math.sqrt(max(1, len(terms)))
    out = []
    for numbers, bins, weights, (slope, offset) in zip(([*measures, said], meta), v.bins, v.weights, v.scale, strict=True):
        z, at = weights[-1], 0
        for x, edges in zip(numbers, bins.edges, strict=True):
            z += weights[at + sum(e <= x for e in edges)]
            at += len(edges) + 1
        out.append(slope * max(-12.0, min(12.0, z)) + offset)
    z = (sum(out) - model.prior) * model.scale[0] + model.scale[1]
    return [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in (*out, z)]


def test_quality_scores_recomputed(spark):
    docs = common.table(spark, SF, "documents")
    model = quality.train(docs, common.table(spark, SF, "labels"))
    got = {r.doc_id: (r.text_score, r.meta_score, r.score) for r in quality.score(docs, model).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and model.constant is None
    for r in rows:
        assert np.allclose(got[r.doc_id], plain_score(model, r.text, r.source, r.lang, r.n_chars), atol=1e-9)
    kept = {r.doc_id for r in quality.keep_good(docs, model).collect()}
    assert kept == {i for i, (*_, s) in got.items() if s >= 0.5} and 0 < len(kept) < len(rows)


def test_digests_that_clash(spark, monkeypatch):
    """Texts whose digests are equal are grouped by the texts themselves."""

    class Weak:
        def __getattr__(self, name):
            return getattr(F, name)

        def sha2(self, text, bits):
            return F.sha2(F.substring(text, 1, 1), bits)

    monkeypatch.setattr(exact_dedup, "F", Weak())
    rows = [(1, "apple"), (2, "apple"), (3, "avocado"), (4, "avocado"), (5, "ant"), (6, "bee"), (7, "bee"), (8, None), (9, ""), (None, "apple"), (10, "cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(folder := common.scratch(spark, "clash"))
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(spark, folder).collect()), key=str)
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    want = [(i, max((x for x in g if x is not None), default=None), len(g)) for g in texts.values() for i in g]
    assert got == sorted(((i, k, n, i == k) for i, k, n in want), key=str)
    assert sorted(r.text or "" for r in exact_dedup.keep_first(spark, docs).collect()) == sorted(texts)


def grouped(rows, percent):
    """The least id of each row's group of near texts, over all pairs."""
    sets, root = {i: near_dup.shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    order = sorted((i for i in sets if len(sets[i])), key=lambda i: len(sets[i]))
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            a, b = len(sets[i]), len(sets[j])
            if 100 * a < percent * b:
                break
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both and 100 * both >= percent * (a + b - both):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def test_the_pipeline_stage_by_stage(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    model = quality.train(docs, labels)
    rows = {r.doc_id: r for r in docs.collect() if plain_score(model, r.text, r.source, r.lang, r.n_chars)[2] >= 0.5}
    assert 0.7 * 1000 < len(rows) < 1000
    left = docs.where(F.col("doc_id").isin(list(rows)))
    machine = toxicity.train(left, labels, toxicity.fold(F.col("id")) != 0)
    rows = {i: r for i, r in rows.items() if machine.score(toxicity.terms(r.text)) < 0.5}
    said = {r.doc_id: r.toxic for r in labels.collect()}
    assert sum(said.get(i) == 1 for i in rows) < 0.3 * sum(x == 1 for x in said.values())
    last = {}
    for i, r in rows.items():
        last[r.text] = max(i, last.get(r.text, i))
    rows = {i: r for i, r in rows.items() if last[r.text] == i}
    root = grouped([(i, r.text) for i, r in rows.items()], corpus_pipeline.PERCENT)
    rows = {i: r for i, r in rows.items() if root[i] == i}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == set(rows)
    ids = packing.pack(docs.where(F.col("doc_id").isin(list(rows))), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    want = {r.doc_id: r.n for r in ids.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    got, fill = {}, {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
