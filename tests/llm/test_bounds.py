"""What reaches the driver is bounded where one labelled identifier holds most rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmill.llm import line_crf, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def hot(spark):
    rows = [(7, f"hot row number {k} with some idiot words, such as these. " * 3, "en", "s", 90) for k in range(3000)]
    rows += [(100 + k, f"A plain line {k} of good words that ends. " * 4 if k % 2 else f"BAD!! {k} $$$ &&& *** " * 9, "en", "s", 90) for k in range(80)]
    labels = [(7, 0, 1)] + [(100 + k, k % 2, int(k % 10 == 0)) for k in range(80)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(hot, monkeypatch):
    docs, labels = hot
    taken, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows, y: taken.append(len(rows)) or fit(rows, y))
    toxicity.train(docs, labels, F.lit(True), sample=200)
    assert taken == [200]


def test_quality(hot, monkeypatch):
    docs, labels = hot
    taken, train = [], quality.co_train
    monkeypatch.setattr(quality, "co_train", lambda own, *how: taken.append(len(own)) or train(own, *how))
    quality.train(docs, labels, sample=200, rounds=1)
    assert taken == [200]


def test_lines(hot, monkeypatch):
    docs, labels = hot
    taken, fit = [], line_crf.fit
    monkeypatch.setattr(line_crf, "fit", lambda chains, *how: taken.append(len(chains)) or fit(chains, *how))
    line_crf.train(docs, labels, sample=200)
    assert taken == [200]


def test_workers_keep_no_words_of_a_task(spark):
    """A worker's cache of words would stay beside what later stages hold."""
    docs = spark.createDataFrame([(k, f"word{k} other{k % 7}") for k in range(400)], "doc_id long, text string").repartition(4)
    m = toxicity.Machine(0.0, np.zeros(1 << toxicity.BITS), np.zeros((1 << toxicity.BITS, toxicity.RANK)))
    assert toxicity.keep_clean(docs, m).count() == 0 and toxicity.score(docs, m).where("score = 0.5").count() == 400

    def kept(batches):
        yield from (pa.RecordBatch.from_pydict({"n": [toxicity._term.cache_info().currsize]}) for _ in batches)

    assert {r.n for r in docs.mapInArrow(kept, "n long").collect()} == {0}
