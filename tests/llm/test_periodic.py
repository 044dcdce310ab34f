"""Operator 11 against a quadratic search, and its query against a plain reading of its contract."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from quillmill.llm import common, periodic


def plain(s):
    """start, length, period of all runs, by comparing at every distance."""
    out = {}
    for q in range(1, len(s) // 3 + 1):
        i = 0
        while i + q < len(s):
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((i, j - i, q) for (i, j), q in out.items()), key=lambda r: (r[0], r[2]))


def made(rng):
    s = []
    while len(s) < rng.choice([30, 60, 150, 300]):
        kind = rng.random()
        if kind < 0.4:
            s += [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 30))]
        elif kind < 0.8:
            u = [rng.randrange(rng.choice([2, 3, 9])) for _ in range(rng.randrange(1, 25))]
            m = rng.randrange(1, 9)
            s += (u * m)[: rng.randrange(1, len(u) * m + 1)]
        else:
            a = rng.randrange(len(s) + 1)
            s += s[a : a + rng.randrange(40)]
    return s


def test_z_function():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(0, 40))]
        z = periodic.z_function(s)
        for i in range(1, len(s)):
            k = 0
            while i + k < len(s) and s[k] == s[i + k]:
                k += 1
            assert z[i] == k


def test_runs():
    rng = random.Random(5)
    for _ in range(500):
        ids = common.interned(made(rng))
        assert periodic.runs(ids) == plain(ids.tolist())
    assert periodic.runs(np.zeros(100_000, dtype=np.int64)) == [(0, 100_000, 1)]
    assert periodic.runs(np.arange(90_000) % 30_000) == [(0, 90_000, 30_000)] and periodic.runs(np.arange(89_999) % 30_000) == []


def contract(id_, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(id_).encode())
    if id_ is not None and h % 10 == 0 and n > 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = plain(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (id_, len(found), *best, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_query(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, " ".join(f"w{x}" for x in made(rng)), "en") for k in range(150)]
    rows += [(200, None, "en"), (201, "", None), (202, " \n\t", "en"), (203, "x " * 5000, "en"), (203, "x " * 5000, "en"), (None, "a b " * 30, "en"), (-3, "é x 中文 y\x0b" * 40, "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, period string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, periodic.query(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((contract(i, t) for i, t, _ in rows), key=str)
    empty = periodic.collapse(spark.createDataFrame([], "doc_id long, text string, runs int, collapsed string"))
    assert empty.collect() == []


def test_on_the_smallest_tables(spark):
    got = sorted(map(tuple, periodic.query(spark, "/root/testdata/sf0.001").collect()))
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    assert got == sorted(contract(*r) for r in docs) and sum(r[1] > 0 for r in got) > 5
