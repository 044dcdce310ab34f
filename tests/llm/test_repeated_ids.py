"""Near dedup where ids repeat: texts are told apart, and work stays in proportion to the rows."""

import random

from quillmill.llm import near_dup


def text(seed, n=60):
    rng = random.Random(seed)
    return [f"{rng.randrange(10**6):x}" for _ in range(n)]


def near(seed):
    w = text(seed)
    w[0] = "other"
    return " ".join(w)


def test_keep_one_decides_by_texts(spark):
    a, b, c = (" ".join(text(k)) for k in "abc")
    rows = [(1, a), (1, b), (2, near("a")), (0, c), (5, near("c")), (5, " ".join(text("d"))), (1, a), (None, a), (7, None), (7, b)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, mark int")
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    want = [(1, a), (1, a), (1, b), (0, c), (5, " ".join(text("d"))), (None, a), (7, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_a_repeated_id_is_linear(spark, monkeypatch):
    rows = [(9, " ".join(text(f"x{k}", 20))) for k in range(700)] + [(9, near(f"y{k % 40}")) for k in range(80)] + [(100 + k, " ".join(text(f"y{k}"))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    seen, sets = [], near_dup._sets

    def counted(df, *how):
        seen.append(df.count())
        return sets(df, *how)

    monkeypatch.setattr(near_dup, "_sets", counted)
    kept = {(r.doc_id, r.text) for r in near_dup.keep_one(docs).collect()}
    assert seen[0] <= len(rows)
    assert len(kept) == 740 and all(i == 9 for i, _ in kept)
