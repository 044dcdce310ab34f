"""Operator 12 against its SQL, a plain count, and a partition whose hashes collide."""

import itertools
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmill.llm import audit

LONG = "Aa bb cc, dd. " * 3000


def plain(docs, labels):
    rows = []
    for i, t, p in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)),
            i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        ]
        said = [(q, x) for j, q, x in labels if j is not None and j == i]
        rows.append((p or "", dict(zip("ABCDE", fails, strict=True)), any(q == 1 for q, _ in said), any(x == 1 for _, x in said)))
    out, total = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                hit = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                failing = [r for r in own if r[1][f]]
                alone = sum(sum(r[1].values()) == 1 for r in failing)
                out[part, order, step] = (len(left), len(hit), len(failing) - len(hit), alone, sum(r[2] for r in hit), sum(r[3] for r in hit))
                total[part, f] = total.get((part, f), 0) + len(hit)
    return sorted((*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items())


@pytest.fixture(scope="module")
def data():
    base = ["x y z " * 10, LONG, LONG + "!", "", None, "A | b", " ".join(f"w{k}" for k in range(60)), "é" * 300 + "a", "é" * 300 + "b"]
    docs = [(k, base[k % len(base)], ["s", "t", None, ""][k % 4]) for k in range(60)] + [(None, base[1], "s"), (None, "", "u"), (7, base[1], "s"), (7, base[1], "t"), (100, "alone", "s")]
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 60, 3)] + [(3, 1, None), (None, 1, 1), (999, 1, 1), (100, None, 1)]
    return docs, labels


def frames(spark, data):
    docs, labels = data
    docs = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, source string, mask int, step int")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_counts(spark, data):
    docs, labels = frames(spark, data)
    got = sorted(map(tuple, audit.audit(docs, labels, block=8).collect()))
    assert got == plain(*data)


def test_sql(spark, data):
    docs, labels = frames(spark, data)
    documents, labels = docs.drop("mask", "step").toPandas(), labels.toPandas().astype("Int64")
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    with duckdb.connect() as c:
        c.register("documents", documents)
        c.register("labels", labels)
        assert sorted(c.sql(audit.SQL).fetchall()) == plain(*data)


def test_hashes_that_collide(spark, data):
    docs, labels = frames(spark, data)

    def weak(text, length, block):
        return F.array(F.lit(1).cast("long"), F.pmod(length, F.lit(3)).cast("long"))

    assert sorted(map(tuple, audit.audit(docs, labels, hashes=weak).collect())) == plain(*data)


def test_block_hashes_reach_the_end(spark):
    lengths = [0, 1, 7, 8, 9, 71, 72, 73, 583, 584, 585, 5000]
    df = spark.createDataFrame([(n, "é" * n) for n in lengths] + [(n, "é" * (n - 1) + "x") for n in lengths if n], "n int, text string")
    got = df.select("n", "text", audit.block_hashes(F.col("text"), F.length("text"), 8).alias("h")).collect()
    assert len({r.h[-1] for r in got}) == len(got) and [len(r.h) for r in got[: len(lengths)]] == [2, 2, 2, 2, 3, 3, 3, 4, 4, 4, 5, 6]


def test_empty(spark, data):
    docs, labels = frames(spark, data)
    assert audit.audit(docs.limit(0), labels).collect() == []
    assert sum(r.good_lost for r in audit.audit(docs, labels.limit(0)).collect()) == 0
