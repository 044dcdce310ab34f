"""Operator 1: toxicity by a factorization machine over hashed terms.

A document is the set of its terms: lower-cased words without the punctuation around them, and the first `STEM` letters
of words that have as many, so that inflected forms share a term. Terms are hashed to 2^`BITS` buckets. The machine scores

    w0 + sum of w[i] + sum over pairs of <v[i], v[j]>

over the terms that tell the labels apart, alone or next to another term; the pair term, computed in linear time from the
sum of the vectors and the sum of their squares, learns combinations that no sum of weights shows, such as an insult
next to the mention of a group. It is trained by AdaGrad on logistic loss, on the driver.

A term tells the labels apart alone if its share of positive rows has a likelihood ratio of `EVIDENCE` or more over all
training rows, which chance gives about twice in 10^4 terms: without this screen the machine learns single documents by
their rare words. Two terms tell them apart next to each other if each has that evidence within the rows that hold the
other, whatever both say alone, and if their log-odds together aren't the sum of both; the bound grows with twice the logarithm of the number of terms tried, so that chance
passes a term as rarely. All pairs of terms are tried (see `paired`).

Training takes labelled rows of the allowed folds only, at most `SAMPLE` of them, those with the least hash of the id
among them: a bounded, documented sample that doesn't depend on partitions. Of each only its bucket numbers reach the
driver, as an array. The model (2^BITS x (1 + RANK) floats, 9 MB) is broadcast; its size is fixed by these constants.
Scoring is one pass without shuffles, over whole texts.

Defined cases: null and empty texts have no terms and get the score of the bias; unlabelled and null-labelled rows don't
train; several labels for one id each count; with no training row, or one class only, all scores are the base rate
(0 with no row at all); an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 18
RANK = 8
STEM = 5
EVIDENCE = 14.0
SAMPLE = 24_000
EPOCHS = 12
RATE = 0.1
DECAY = 1e-5
WORDS = re.compile(r"[^\W_]+")


@lru_cache(maxsize=200_000)
def _term(word: str) -> tuple[int, ...]:
    mask = (1 << BITS) - 1
    full = zlib.crc32(word.encode("utf-8")) & mask
    return (full, zlib.crc32(("^" + word[:STEM]).encode("utf-8")) & mask) if len(word) >= STEM else (full,)


def terms(text: str | None) -> np.ndarray:
    """The sorted distinct buckets of a text."""
    found = {t for w in set(WORDS.findall((text or "").lower())) for t in _term(w)}
    return np.array(sorted(found), dtype=np.int32)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, few at a time. After the last no word is kept: the worker lives on, beside those of later stages."""
    try:
        for b in common.releasing(batches):
            for at in range(0, b.num_rows, 256):
                yield b.slice(at, 256)
    finally:
        _term.cache_clear()


class Machine:
    def __init__(self, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.bias, self.weights, self.vectors = bias, weights, vectors

    def raw(self, x: np.ndarray) -> float:
        v = self.vectors[x]
        s = v.sum(axis=0)
        return float(self.bias + self.weights[x].sum() + 0.5 * (s @ s - (v * v).sum()))

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(x), -35, 35))))


def evidence(hits: np.ndarray, seen: np.ndarray, rate: float) -> np.ndarray:
    """Twice the log-likelihood ratio of `hits` among `seen` against the common rate."""
    miss = seen - hits
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(hits > 0, hits * np.log(hits / (seen * rate)), 0)
        b = np.where(miss > 0, miss * np.log(miss / (seen * (1 - rate))), 0)
    return 2 * (a + b)


def _counts(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many rows each bucket is, and in how many positive ones."""
    seen, hits = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for x, y in zip(rows, labels, strict=True):
        seen[x] += 1
        hits[x] += y
    return seen, hits


def paired(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Buckets of the terms of all pairs whose members each tell the labels apart next to the other, beyond their sum.

    Evidence within the rows of a term is twice their number times the entropy of their labels at most. Only terms below
    the bound by that are left out beforehand, which can't be in such a pair.
    """
    seen, hits = _counts(rows, labels)
    share = np.divide(hits, seen, out=np.zeros_like(seen), where=seen > 0)
    most = -2 * (hits * np.log(np.where(hits > 0, share, 1)) + (seen - hits) * np.log(np.where(hits < seen, 1 - share, 1)))
    bound = EVIDENCE + 2 * np.log(max(1, (most >= EVIDENCE).sum()))
    pool = np.flatnonzero(most >= bound)
    d, place = max(1, len(pool)), np.full(len(seen), -1, dtype=np.int32)
    place[pool] = np.arange(len(pool))
    short = [p[p >= 0] for p in (place[x] for x in rows)]
    low = max(1, len(rows).bit_length())
    held = np.empty(sum(map(len, short)), dtype=np.int64)
    for r, (end, x) in enumerate(zip(np.cumsum([len(x) for x in short]), short, strict=True)):
        held[end - len(x) : end] = x.astype(np.int64) << low | r
    held.sort()
    holds = (held & ((1 << low) - 1)).astype(np.int32)
    del held
    ends = np.cumsum([0, *seen[pool].astype(np.int64)])

    def count(which: np.ndarray) -> np.ndarray:
        got = np.zeros(d, dtype=np.int64)
        for k in range(0, len(which), 2048):
            got += np.bincount(np.concatenate([short[r] for r in which[k : k + 2048]]), minlength=d)
        return got

    found = [np.empty(0, dtype=np.int64)]
    for t in range(len(pool)):
        which = holds[ends[t] : ends[t + 1]]
        n, yes = count(which), count(which[labels[which] > 0])
        h, of = int(hits[pool[t]]), len(which)
        n[t] = 0
        i = np.flatnonzero(n)
        i = i[evidence(yes[i], n[i], h / of) + evidence(h - yes[i], of - n[i], h / of) >= bound]
        odds, noise = 0.0, 0.0  # the log-odds of both terms, less what each adds without the other
        rest_n, rest_y = seen[pool[i]] - n[i], hits[pool[i]] - yes[i]
        for sign, m, y in ((1, n[i], yes[i]), (-1, of - n[i], h - yes[i]), (-1, rest_n, rest_y), (1, len(rows) - of - rest_n, labels.sum() - h - rest_y)):
            odds = odds + sign * np.log((y + 0.5) / (m - y + 0.5))
            noise = noise + 1 / (y + 0.5) + 1 / (m - y + 0.5)
        i = i[odds * odds / noise >= EVIDENCE]
        found.append(t * d + i)
    one = np.concatenate(found)
    return pool[np.unique(one[np.isin(one % d * d + one // d, one)] // d)]


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> Machine:
    """Train on bucket sets and 0/1 labels."""
    n = 1 << BITS
    weights, vectors = np.zeros(n), np.zeros((n, RANK))
    rate = float(labels.mean()) if len(labels) else 0.0
    bias = float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9))) if len(labels) else -35.0
    if not 0 < rate < 1:
        return Machine(bias, weights, vectors)
    seen, hits = _counts(rows, labels)
    known = evidence(hits, seen, rate) >= EVIDENCE
    # copies of a row are no further evidence of its pairs
    apart = list({(xxhash.xxh3_128_digest(x), y): k for k, (x, y) in enumerate(zip(rows, labels, strict=True))}.values())
    known[paired([rows[k] for k in apart], labels[apart])] = True
    rows = [x[known[x]] for x in rows]
    rng = np.random.default_rng(seed)
    vectors[known] = 0.01 * rng.standard_normal((int(known.sum()), RANK))
    gw, gv, gb = np.full(n, 1e-4), np.full((n, RANK), 1e-2), 1e-2
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            x = rows[k]
            v = vectors[x]
            s = v.sum(axis=0)
            z = bias + weights[x].sum() + 0.5 * (s @ s - (v * v).sum())
            e = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[k]
            gb += e * e
            bias -= RATE * e / np.sqrt(gb)
            dw = e + DECAY * weights[x]
            gw[x] += dw * dw
            weights[x] -= RATE * dw / np.sqrt(gw[x])
            dv = e * (s - v) + DECAY * v
            gv[x] += dv * dv
            vectors[x] -= RATE * dv / np.sqrt(gv[x])
    vectors[~known] = 0
    return Machine(bias, weights, vectors)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Machine:
    """Fit on the labelled rows of docs for which `allowed`, a condition on the column `id`, holds."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & allowed)
    known = F.broadcast(common.few(known, sample))  # of bounded size
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(known, "id")

    def run(batches):
        for b in _parts(batches):
            found = [terms(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([x.tobytes() for x in found], pa.binary())], names=["key", "label", "terms"])

    got = texts.select("text", F.xxhash64("id").alias("key"), "label").mapInArrow(run, "key long, label int, terms binary")
    if texts.select("id").count() > sample:  # ids repeat
        got = got.orderBy("key", "label", "terms").limit(sample)
    got = got.toArrow()
    got = got.sort_by([("key", "ascending"), ("label", "ascending"), ("terms", "ascending")])
    rows = [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in got.column("terms")]
    machine = fit(rows, got.column("label").to_numpy().astype(np.float64))
    del rows, got
    pa.default_memory_pool().release_unused()  # the driver's, before other steps
    return machine


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weights.astype(np.float32), machine.vectors.astype(np.float32)))

    def run(batches):
        m = Machine(*held.value)
        for b in _parts(batches):
            scores = [m.score(terms(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, machine: Machine, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of docs with a score below the limit, all columns, in one pass."""
    held = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weights.astype(np.float32), machine.vectors.astype(np.float32)))
    at = docs.columns.index(text_col)

    def run(batches):
        m = Machine(*held.value)
        for b in _parts(batches):
            yield b.filter(pa.array([m.score(terms(t)) < limit for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(id_: Column) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(5))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    machine = train(docs, common.table(spark, sf_dir, "labels"), fold(F.col("id")) != 0)
    out = score(docs, machine)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
