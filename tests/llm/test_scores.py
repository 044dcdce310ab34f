"""The queries' rows against plain recomputation: scores by the quadratic sum over pairs, digests by the public library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from quillmill.llm import bpe, common, toxicity

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_toxicity_query_by_brute_force(spark):
    """Every row's score is the bias, the weights and all pairs of vectors of its terms, one by one."""
    docs, labels = (common.table(spark, LARGER, t) for t in ("documents", "labels"))
    m = toxicity.train(docs, labels, toxicity.fold(F.col("id")) != 0)
    weights, vectors = m.weights.astype(np.float32), m.vectors.astype(np.float32).astype(np.float64)
    got = {r.doc_id: r for r in toxicity.query(spark, LARGER).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        x = [t for t in toxicity.terms(r.text) if weights[t] or vectors[t].any()]
        z = m.bias + float(weights[x].astype(np.float64).sum()) + sum(float(vectors[a] @ vectors[b]) for k, a in enumerate(x) for b in x[:k])
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-np.clip(z, -35, 35)))) < 1e-4
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5) and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_held_out_labels_are_never_read(spark):
    """Other labels of the held-out fold change no score."""
    docs, labels = (common.table(spark, SMALL, t) for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.score(docs, toxicity.train(docs, x, toxicity.fold(F.col("id")) != 0)).collect())) for x in (labels, other))
    assert a == b


def test_bpe_query_by_the_library(spark):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    lib = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.query(spark, SMALL).collect()}
    want = {}
    for r in common.table(spark, SMALL, "documents").collect():
        ids, text = lib.encode_ordinary(r.text or ""), (r.text or "").encode()
        want[r.doc_id] = (len(ids), *(hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), text)))
    assert got == want
