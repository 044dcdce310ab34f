"""Operator 11: periodic runs of words, found by divide and conquer after Main and Lorentz.

A run is a stretch of words with smallest period q (words q apart are identical) of at least max(`LEAST`, `TIMES` * q)
words that no neighbouring word extends. Words are interned as numbers. A segment is halved; the Z-functions of its right
half followed by its left half, and of both reversed, give for each period how far equality at that distance reaches to
both sides of the midpoint, so each repetition across it is known in time linear in the segment. What runs on beyond the
segment is left to the segments above, which hold it whole. Both halves follow. An interval found with several periods
keeps the smallest.

A run repeats 16 words or more at its period's distance, so only stretches of a text where 16 words recur are segments at
all (exact numbers of 16-word windows, by doubling); most texts have none. The work is n log n for any text, and a text is
one row: nothing is shuffled.

Defined cases: a null or empty text has no words and no runs; a null identifier is passed on; repeated rows are each
measured; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST = 24
TIMES = 3
#: Words that any run repeats at its period's distance: 24 - 8 of the shortest, 2 * 9 and more where the period is over 8.
SEED = 16

RUN = "struct<start: bigint, length: bigint, period: bigint>"


def z_function(s: list[int]) -> list[int]:
    """For each position, how many items from there equal those from the start; 0 at the start itself."""
    n, left, right = len(s), 0, 0
    z = [0] * n
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _across(s: list[int], lo: int, mid: int, hi: int) -> list[tuple[int, int, int]]:
    """start, end, period of what repeats across mid within s[lo:hi] and doesn't run on beyond it."""
    left, right = s[lo:mid], s[mid:hi]
    a, b = len(left), len(right)
    back, ahead = (np.array(z_function(x)) for x in (left[::-1] + [-1] + right[::-1], right + [-1] + left))
    p = np.arange(1, (a + b) // TIMES + 1)
    # equality at distance p: before mid - p, from mid - 1 down, from mid - p up (both at most p), and from mid on
    before, down, up, on = back[p], np.minimum(back[a + 1 + b - p], p), np.minimum(ahead[b + 1 + a - p], p), ahead[p]
    start = mid - np.where(up > 0, np.where((down == p) | (up < p), p + before, down), down)
    end = mid + np.where(down == p, p + on, up)
    out = []
    for x, y, ok in ((mid - p - before, mid + up, (up > 0) & (up < p)), (mid - down, mid + p + on, (down > 0) & (down < p)), (start, end, down == p)):
        for k in np.flatnonzero(ok & (y - x >= np.maximum(LEAST, TIMES * p))).tolist():
            i, j, q = int(x[k]), int(y[k]), k + 1
            if (i > lo or i == 0 or s[i - 1] != s[i - 1 + q]) and (j < hi or j == len(s) or s[j] != s[j - q]):
                out.append((i, j, q))
    return out


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """start, length, period of all runs of a sequence of numbers from 0, by start, then period."""
    n = len(ids)
    if n < LEAST:
        return []
    gram = common.window_numbers(ids, SEED)
    order = np.argsort(gram, kind="stable")
    again = np.flatnonzero(gram[order[1:]] == gram[order[:-1]])
    at, next_ = order[again], order[again + 1]
    near = next_ - at <= n // TIMES
    at, next_ = at[near], next_[near]
    if not len(at):
        return []
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, next_ + SEED, -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(cover[:n]) > 0, [0]]).astype(np.int8)))
    # the least end of a recurring window that starts at a position or later: a segment with none inside has no run
    ends = np.full(n + 1, 2 * n, dtype=np.int64)
    np.minimum.at(ends, at, next_ + SEED)
    ends = np.minimum.accumulate(ends[::-1])[::-1]
    s, found, todo = ids.tolist(), {}, list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
    while todo:
        lo, hi = todo.pop()
        if hi - lo < LEAST or ends[lo] > hi:
            continue
        mid = (lo + hi) // 2
        for i, j, q in _across(s, lo, mid, hi):
            found[i, j] = min(q, found.get((i, j), q))
        todo += [(lo, mid), (mid, hi)]
    return sorted(((i, j - i, q) for (i, j), q in found.items()), key=lambda r: (r[0], r[2]))


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length over period; ties go to the smallest start, then period."""
    return max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not found:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()])


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period), strongest (null without runs), collapsed: one row per row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.struct([(f, pa.int64()) for f in ("start", "length", "period")])
    named = lambda r: None if r is None else {"start": r[0], "length": r[1], "period": r[2]}

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                words = [common.words(t) for t in part.column(1).to_pylist()]
                found = [runs(common.interned(w)) for w in words]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(map(len, words), pa.int64()),
                        pa.array([[named(r) for r in f] for f in found], pa.list_(run_type)),
                        pa.array([named(strongest(f)) for f in found], run_type),
                        pa.array([collapsed(w, f).decode("utf-8") for w, f in zip(words, found, strict=True)], pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "strongest", "collapsed"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs array<{RUN}>, strongest {RUN}, collapsed string")


def planted(id_: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a row, those of a tenth of the identifiers repeated with a period by their hash; a null one's never."""
    n, h = len(words), 1 if id_ is None else zlib.crc32(str(id_).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def with_planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text: the text's words after `planted`, joined by one space."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [b" ".join(planted(i, common.words(t))).decode("utf-8") for i, t in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collapse(with_planted(common.table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = F.col("strongest")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(best[f].alias(f) for f in ("start", "length", "period")),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
