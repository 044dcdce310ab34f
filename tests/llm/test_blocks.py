"""Nearest neighbours over several blocks and batches of queries, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from quillmill.llm import ann


def brute(rows, queries, k):
    out = {}
    for i in {q for q, _ in queries}:
        best = {}
        for own in [np.array(v, dtype=np.float64) for q, v in queries if q == i]:
            for n, (j, v) in enumerate(rows):
                if j != i and len(v) == len(own):
                    x = np.array(v, dtype=np.float64)
                    s = float(x @ own / np.sqrt(x @ x) / np.sqrt(own @ own))
                    best[n] = max(best.get(n, (-2.0, 0)), (s, -j))
        out[i] = sorted(best.values(), reverse=True)[:k]
    return out


def test_blocks_and_batches(spark, monkeypatch):
    """With the whole block as quota the result is exact, over blocks, batches, lengths and repeated ids."""
    monkeypatch.setattr(ann, "BLOCK_BYTES", 8 * 6 * 150)
    monkeypatch.setattr(ann, "CHUNK_BYTES", 8 * 6 * 300)
    monkeypatch.setattr(ann, "GROUPS", 3)
    rng = np.random.default_rng(4)
    rows = [(int(i % 700), rng.standard_normal(6 if i % 4 else 3).round(6).tolist()) for i in range(1500)]
    queries = [r for r in rows if r[0] % 3 == 0] + [(0, rng.standard_normal(6).tolist()) for _ in range(2500)]
    df, ask = (spark.createDataFrame(x, "vec_id long, embedding array<double>") for x in (rows, queries))
    out = ann.search(df, ask, k=5, quota=1000.0)
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, -r.vec_id)
    want = brute(rows, queries, 5)
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert [got[i][k + 1][1] for k in range(5)] == [j for _, j in w] and np.allclose([got[i][k + 1][0] for k in range(5)], [s for s, _ in w], atol=1e-12)


def test_sizes_of_numbers(spark):
    rows = [(0, [1e200, 2e200]), (1, [2e-200, 4e-200]), (2, [1e-310, 0.0]), (3, [-1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in ann.search(df, df).collect()}
    assert len(got) == 12 and abs(got[0, 1] - 1) < 1e-15 and abs(got[0, 2] - 5**-0.5) < 1e-9 and abs(got[2, 3] + 2**-0.5) < 1e-9


def test_a_query_sends_on_few_rows(spark, monkeypatch):
    """Rows and queries are written once; what the tasks send on grows with the queries and not with the blocks."""
    monkeypatch.setattr(ann, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(ann, "CHUNK_BYTES", 8000)
    monkeypatch.setattr(ann, "GROUPS", 4)
    df = spark.range(2000).select(F.col("id").alias("vec_id"), F.array(*[F.rand(k) for k in range(4)]).alias("embedding"))
    out = ann.search(df, df.where("vec_id % 10 = 0"))
    assert out.count() == 5 * 200
    plan = out._jdf.queryExecution().executedPlan()
    assert "Join" not in plan.toString()
