"""Saves that fail, savers that meet, snapshots."""

import threading

import pytest

from quillmill.operators import postings
from quillmill.plans import store as stores
from quillmill.plans.store import Conflict, Store


def ids(df):
    return sorted(r.idx for r in df.collect())


def test_a_failed_save_keeps_the_set(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.save(spark.range(3).toDF("idx"), "s", "parquet", {"k": 1})
    held = store.load("s")
    bad = spark.range(3).selectExpr("if(id = 2, raise_error('no'), id) AS idx")
    for how in (lambda: store.save(bad, "s"), lambda: store.update(bad, "s")):
        with pytest.raises(Exception, match="no"):
            how()
        assert ids(store.load("s")) == [0, 1, 2] and store.versions("s") == [1]
    store.update(store.load("s").where("idx > 0"), "s")  # from itself
    entry = store.catalog()["s"]
    assert ids(store.load("s")) == [1, 2] and ids(held) == [0, 1, 2] and entry["version"] == 2 and entry["custom_metadata"] == {"k": 1}


def test_savers_that_meet(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.save(spark.range(1).toDF("idx"), "s", "parquet")
    with pytest.raises(Conflict):
        store.save(spark.range(2).toDF("idx"), "s", "parquet", expected=0)
    late = store.load("s")
    store.save(spark.range(5).toDF("idx"), "s", "parquet")
    with pytest.raises(Conflict):
        store.update(late, "s", expected=1)
    assert ids(store.load("s")) == [0, 1, 2, 3, 4]
    # one comes between another's look at the versions and its commit
    commit, raced = Store._commit, []

    def slow(self, name, version, entry):
        if not raced:
            raced.append(version)
            commit(self, name, version, {"path": "x", "other": True})
        return commit(self, name, version, entry)

    monkeypatch.setattr(Store, "_commit", slow)
    assert store.save(spark.range(2).toDF("idx"), "s", "parquet")["version"] == raced[0] + 1
    raced.clear()
    with pytest.raises(Conflict):
        store.update(spark.range(2).toDF("idx"), "s")
    monkeypatch.undo()
    # savers of several sets and of one at the same time: no entry is lost
    def run(k):
        Store(spark, str(tmp_path)).save(spark.range(k + 1).toDF("idx"), f"t{k}", "parquet")
        Store(spark, str(tmp_path)).save(spark.range(k + 1).toDF("idx"), "shared", "parquet")

    threads = [threading.Thread(target=run, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {f"t{k}" for k in range(4)} | {"s", "shared"} == set(store.catalog()) and store.versions("shared") == [1, 2, 3, 4]


def test_snapshots(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    for n in (1, 2, 3):
        store.save(spark.range(n).toDF("idx"), "s", "parquet" if n == 2 else "jsonl")
    assert [len(ids(store.load("s", v))) for v in (1, 2, 3)] == [1, 2, 3]
    assert len(ids(store.load("s"))) == 3 and store.undo("s")["version"] == 4 and len(ids(store.load("s"))) == 2
    store.undo("s")
    assert len(ids(store.load("s"))) == 1
    with pytest.raises(KeyError):
        store.undo("s")
    store.restore("s", 3)
    assert len(ids(store.load("s"))) == 3 and store.vacuum("s") == 2 and len(ids(store.load("s"))) == 3
    store.delete("s")
    assert store.catalog() == {} and not [n for n in store._names(f"{store.base}/s") if n.startswith("data-")]
    with pytest.raises(KeyError):
        store.load("s")
    with pytest.raises(KeyError):
        store.delete("s")
    for bad in ("", "_x", "a/b", ".."):
        with pytest.raises(ValueError):
            store.save(spark.range(1).toDF("idx"), bad)
    store.save(spark.range(4).toDF("idx"), "s", "parquet")
    assert len(ids(store.load("s"))) == 4 and stores.FORMATS


def test_postings_edges(spark, tmp_path):
    kind = "idx long, source_type string, tags array<string>, quality_score double, review_status string"
    rows = [(0, "a", ["x", "x", "y"], 0.05, "ok"), (32767, None, None, None, None), (32768, "a", [], 0.45, "ok"), (10**9, "b", ["y", None], 0.95, None), (None, "a", ["x"], 0.5, "ok")]
    df = spark.createDataFrame(rows, kind)
    index = postings.save(df, str(tmp_path / "i"))
    got = lambda **how: sorted(r.idx for r in postings.numbers(postings.matching(index, **how)).collect())
    assert got() == [0, 32767, 32768, 10**9] and got(source_types=[]) == got() and got(tags=["x"]) == [0]
    assert got(tags=["y", "y"], tag_mode="all") == [0, 10**9] and got(tags=["x", "y"], tag_mode="all") == [0] and got(tags=["none"]) == []
    assert got(quality=(0.1, 0.5)) == [0, 32768] and got(quality=(None, 0.4)) == [0]
    with pytest.raises(ValueError):
        got(tags=["x"], tag_mode="some")
    assert postings.select(df, postings.matching(index, statuses=["ok"])).count() == 2
    empty = postings.save(df.limit(0), str(tmp_path / "e"))
    assert postings.count(postings.matching(empty)).first().n == 0 and postings.distributions(empty).count() == 0
