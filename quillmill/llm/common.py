"""Shared plumbing: input tables and deterministic ranges of an order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.plans.scratch import remove, removed_after, scratch, shared_dir, written  # noqa: F401

#: Sampled keys that reach the driver to place cuts, at any size of the input (Spark's range partitioner takes up to 10^6).
KEYS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def releasing(batches: Iterator) -> Iterator:
    """The batches; after the last, Arrow's free memory goes back to the system: the worker lives on, beside those of later stages."""
    yield from batches
    pa.default_memory_pool().release_unused()


class Ranges:
    """Consecutive ranges of the order (id, tie), null ids first. A null or repeated id is cut between its ties."""

    def __init__(self, cuts: list[tuple[int | None, int]]):
        self.count = len(cuts) + 1
        self.of_null = np.array([t for i, t in cuts if i is None], dtype=np.int64)
        self.ids, self.ties = (np.array([c[k] for c in cuts if c[0] is not None], dtype=np.int64) for k in (0, 1))

    def find(self, ids: np.ndarray, null: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """The range of each key: how many cuts are at it or before it."""
        out, end = np.searchsorted(self.ids, ids, side="left"), np.searchsorted(self.ids, ids, side="right")
        for lo in np.unique(out[(end > out) & ~null]):  # keys whose id is a cut's
            at = np.flatnonzero((out == lo) & (end > out))
            out[at] = lo + np.searchsorted(self.ties[lo : end[at[0]]], ties[at], side="right")
        return np.where(null, np.searchsorted(self.of_null, ties, side="right"), out + len(self.of_null)).astype(np.int32)

    def of(self, id_: Column, tie: Column) -> Column:
        if self.count == 1:
            return F.lit(0)

        @F.arrow_udf("int")
        def find(i: pa.Array, null: pa.Array, t: pa.Array) -> pa.Array:
            return pa.array(self.find(i.to_numpy(), null.to_numpy(zero_copy_only=False), t.to_numpy()), pa.int32())

        return find(F.coalesce(id_, F.lit(0)).cast("long"), id_.isNull(), tie)


def ranges(df: DataFrame, id_: Column, tie: Column, weight: Column, target: int, per_range: int = 64) -> Ranges:
    """Ranges of about `target` weight each, `KEYS` / 8 of them at most: beyond that they grow with the input.

    The sample is chosen by a hash of the key, so the same input always gives the same cuts. `per_range` sampled keys a
    range reach the driver, fewer where that would be over `KEYS`.
    """
    df = df.select(id_.alias("id"), tie.alias("tie"), weight.cast("double").alias("w"))
    n, total = df.agg(F.count(F.lit(1)), F.sum("w")).first()
    count = min(int(np.ceil((total or 0) / target)), KEYS // 8)
    if count < 2:
        return Ranges([])
    step = max(1, n // min(count * per_range, KEYS))
    got = df.where(F.pmod(F.xxhash64("id", "tie"), F.lit(step)) == 0).groupBy("id", "tie").agg(F.sum("w").alias("w")).toArrow()
    rows = sorted(zip(*(c.to_pylist() for c in got.columns), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    if not rows:
        return Ranges([])
    sums = np.cumsum([w for *_, w in rows])
    at = np.searchsorted(sums, sums[-1] * np.arange(1, count) / count)
    return Ranges([rows[i][:2] for i in np.unique(np.minimum(at, len(rows) - 1))])


def words(text: str | None) -> list[bytes]:
    """The words of a text: what stands between ASCII white space."""
    return (text or "").encode("utf-8").split()


def interned(found: list) -> np.ndarray:
    """A number from 0 for each item, equal items alike."""
    of: dict = {}
    return np.fromiter((of.setdefault(w, len(of)) for w in found), dtype=np.int64, count=len(found))


def window_numbers(ids: np.ndarray, size: int) -> np.ndarray:
    """A number for each window of `size` (a power of 2) items, equal windows alike: exact, by doubling."""
    out, step = ids, 1
    while step < size:
        if len(out) <= step:
            return out[:0]
        _, out = np.unique(out[:-step] * (int(out.max()) + 1) + out[step:], return_inverse=True)
        step *= 2
    return out


def hash_bound(n: int, sample: int) -> int:
    """The 64-bit hashes of about 1.1 times `sample` (and 100) of n rows lie below it; of any number, as it isn't rounded to a grain."""
    return min(-(1 << 63) + ((1 << 64) * (11 * sample + 1000)) // (10 * n), (1 << 63) - 1)


def few(df: DataFrame, sample: int, key: str = "id") -> DataFrame:
    """The rows of df if they are `sample` at most, else that many: those of least hash of the key, sorted out of few more."""
    n = df.count()
    if n <= sample:
        return df
    h = F.xxhash64(key)
    return df.where(h < F.lit(hash_bound(n, sample))).orderBy(h, key).limit(sample)
