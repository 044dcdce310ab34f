"""Operators do the whole job: nothing of the input is left out where it is old, rare, repeated or marginal."""

import glob
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import ann, exact_dedup, near_dup, toxicity
from quillmill.plans.scratch import scratch


def test_exact_dedup_takes_old_files(spark, monkeypatch):
    """A file dated long before those already taken is read; a row that the state doesn't know is an error."""
    folder, state = scratch(spark, "in"), scratch(spark, "state")
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").coalesce(1).write.parquet(folder)
    exact_dedup.dedup(spark, folder, state=state)
    before = set(glob.glob(f"{folder.removeprefix('file:')}/*.parquet"))
    spark.createDataFrame([(3, "a"), (4, "c")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(folder)
    (new,) = set(glob.glob(f"{folder.removeprefix('file:')}/*.parquet")) - before
    os.utime(new, (time.time() - 30 * 86400,) * 2)
    with monkeypatch.context() as m:
        m.setattr(exact_dedup, "advance", lambda *a: None)
        for part in ("doc_id", "keep_id"), ("group_size",), ("first",):
            with pytest.raises(Exception, match="no digest"):
                exact_dedup.dedup(spark, folder, state=state).select(*part).collect()
        with pytest.raises(Exception, match="no digest"):
            exact_dedup.dedup(spark, folder, state=state).where("first").collect()
    got = exact_dedup.dedup(spark, folder, state=state).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(1, 3, 2), (2, 2, 1), (3, 3, 2), (4, 4, 1)]


def test_the_machine_learns_pairs_of_terms_that_say_nothing_alone():
    """Toxic if exactly one of two frequent terms occurs, or by an insult next to any of 40 groups that say nothing alone."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(4000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array(sorted({*([7] if a else []), *([9] if b else []), *rng.integers(100, 400, 5).tolist()}), dtype=np.int32))
        labels.append(float(a != b))
    m = toxicity.fit(rows, np.array(labels))
    assert min(m.score(np.array([7])), m.score(np.array([9]))) > 0.9 > 0.1 > max(m.score(np.array([7, 9])), m.score(np.array([], dtype=np.int32)))
    assert not m.weights[100:400].any()  # chance passes no term

    rows, labels = [], []
    for _ in range(20_000):
        insult, group, other = rng.integers(0, 2), rng.random() < 0.3, rng.integers(0, 2)
        rows.append(np.array(sorted({*([7] if insult else []), *([20 + int(rng.integers(40))] if group else []), *rng.integers(100, 400, 5).tolist()}), dtype=np.int32))
        labels.append(float(insult if group else other))
    m = toxicity.fit(rows, np.array(labels))
    assert min(m.score(np.array([7, g])) for g in range(20, 60)) > 0.8
    assert max(m.score(np.array([g])) for g in range(20, 60)) < 0.2


def test_near_dup_nodes_with_repeated_members(spark):
    """Nodes of different members never have one content, even where each member comes twice."""
    rows = [(n, r) for n, rs in ((1, (10, 11)), (2, (12, 13))) for r in rs for _ in (0, 1)]
    got = near_dup._sized(spark.createDataFrame(rows, "node long, rep long").withColumn("n", F.lit(1))).collect()
    assert len({r.content for r in got}) == 2 and {r.size for r in got} == {4}


def test_near_dup_picks_are_distinct(spark, monkeypatch):
    """With few functions both picks of a node were often equal, which doubled its members."""
    monkeypatch.setattr(near_dup, "SMALL", 2)
    monkeypatch.setattr(near_dup, "SECOND", 1.0)
    monkeypatch.setattr(near_dup, "FUNCTIONS", near_dup.TREES + 2)
    sized, most = near_dup._sized, []

    def spy(nodes):
        most.append(nodes.groupBy("node", "rep").count().agg(F.max("count")).first()[0])
        return sized(nodes)

    monkeypatch.setattr(near_dup, "_sized", spy)
    monkeypatch.setattr(near_dup, "LEVELS", 2)
    rows = [(i, " ".join([f"w{k}" for k in range(60)] + [f"x{i}"])) for i in range(12)]
    near_dup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(most) > 1 and set(most) == {1}


def test_near_dup_takes_all_texts_of_an_id(spark):
    """Each of two texts of one id links the id to its near copies, in whatever order the rows come."""
    a, b = ([f"{c}{k}" for k in range(100)] for c in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "x"])), (3, " ".join([*b, "y"])), (4, "something else")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        assert {r.doc_id: r.component_id for r in near_dup.groups(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_ann_searches_all_vectors_of_a_query(spark):
    """A query's id with two vectors finds the rows near either, each once, in whatever order they come."""
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1]), (4, [0.1, 1.0]), (5, [-1.0, -1.0])], "vec_id long, embedding array<double>")
    asked = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0])]
    for order in (asked, asked[::-1]):
        queries = spark.createDataFrame(order, "vec_id long, embedding array<double>").coalesce(1)
        got = sorted((r["rank"], r.vec_id) for r in ann.search(rows, queries, k=4).collect())
        assert got == [(1, 1), (2, 2), (3, 3), (4, 4)]
