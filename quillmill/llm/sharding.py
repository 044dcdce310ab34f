"""Operator 2: reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered 0..N-1 in the total order (id, text checksum, size). A keyed balanced Feistel network on the
smallest even number of bits that holds N, with cycle walking back into 0..N-1, permutes these numbers; the image p
gives shard p mod S and slot p div S. Shard sizes in rows differ by one at most (law `rows`), slots are gapless, and
both directions are computable from (N, key, S) alone: `place` and `locate`.

The numbering needs two thin shuffles. Rows alike in id, checksum and size become one with a count, partly before the first;
then come range cuts from a hash-chosen sample of keys of fixed size, running sums of counts within each range, and the
ranges' counts, of which the driver holds one long each. Cuts also fall within a null or repeated id, between its checksums,
and copies are numbered in steps of `COPIES`, each a row that any task may take: a row that is a third of all is no task's
load. The row number doesn't depend on how many ranges there are.

Defined cases: a null text has size 1 and checksum 0; null ids come first in the order; rows alike in id, checksum and
size are interchangeable; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 16
KEY = 20240229
ROUNDS = 6
RANGE_ROWS = 200_000
#: Copies of a row that one step numbers.
COPIES = 65_536


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64) of x under a round key."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _network(x: np.ndarray, half: int, keys: list[int], back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for k in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_mix(left, k) & mask), left
        else:
            left, right = right, left ^ (_mix(right, k) & mask)
    return (left << shift) | right


def permute(x: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """A permutation of 0..n-1 applied to x (or its inverse): walk the cycle until back inside the domain."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    keys = [int(_mix(np.array([key * 64 + r], dtype=np.uint64), 0)[0]) for r in range(ROUNDS)]
    with np.errstate(over="ignore"):
        y = _network(x.astype(np.uint64), half, keys, back)
        while (out := y >= np.uint64(n)).any():
            y[out] = _network(y[out], half, keys, back)
    return y.astype(np.int64)


def place(row: np.ndarray, n: int, shards: int = SHARDS, key: int = KEY) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of global row numbers."""
    p = permute(np.asarray(row), n, key)
    return p % shards, p // shards


def locate(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS, key: int = KEY) -> np.ndarray:
    """Global row numbers at the given shards and slots."""
    return permute(np.asarray(slot) * shards + np.asarray(shard), n, key, back=True)


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """doc_id, size, text_crc32, row (0..N-1 in total order), and N."""
    spark = docs.sparkSession
    key = ["doc_id", "text_crc32", "size"]
    thin = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    # rows alike in all three are one with a count, which the numbering passes over in one step
    thin = common.written(thin.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")), common.scratch(spark, "shard-rows"))
    n, most = thin.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.max("__n"), F.lit(0))).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    tie = F.shiftleft("text_crc32", 31) + F.least("size", F.lit((1 << 31) - 1))
    cuts = common.ranges(thin, F.col("doc_id"), tie, F.lit(1), max(1, n // ranges))
    thin = thin.withColumn("__range", cuts.of(F.col("doc_id"), tie))
    starts = np.zeros(cuts.count + 1, dtype=np.int64)
    for r, c in thin.groupBy("__range").agg(F.sum("__n")).collect():
        starts[r + 1] = c
    starts = np.cumsum(starts)

    @F.pandas_udf("long")
    def start(r):
        return pd.Series(starts[r.to_numpy()])

    order = Window.partitionBy("__range").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
    out = thin.withColumn("__first", start("__range") + F.sum("__n").over(order) - F.col("__n"))
    # copies in steps of COPIES, which are dealt anew where there are so many
    out = out.withColumn("__step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / COPIES))))
    if most > COPIES:
        out = out.repartition(*key, "__step")
    last = F.least(F.col("__n"), (F.col("__step") + 1) * COPIES) - 1
    rows = F.explode(F.sequence(F.col("__first") + F.col("__step") * COPIES, F.col("__first") + last)).alias("row")
    return out.select("doc_id", "size", "text_crc32", rows), n


def shard(docs: DataFrame, shards: int = SHARDS, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row, law, shard, slot, grown_shard."""
    rows, n = numbered(docs, id_col, text_col)

    @F.pandas_udf("long")
    def image(row):
        return pd.Series(permute(row.to_numpy(), n, key))

    p = rows.withColumn("__p", image("row"))
    return p.select(
        "doc_id",
        "size",
        "text_crc32",
        "row",
        F.lit("rows").alias("law"),
        (F.col("__p") % shards).cast("int").alias("shard"),
        F.expr(f"__p div {int(shards)}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.table(spark, sf_dir, "documents"))
