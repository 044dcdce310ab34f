"""A text index that skips files: which trigrams of bytes occur in each file of a Parquet table.

A file's filter is a bitmap of `BITS` hashed trigrams of its lower-cased texts' UTF-8, made by the tasks that read it and put
together by an aggregate. A search reads only files whose filter has all trigrams of the needle, and holds their rows against
the needle itself, so it finds what a scan finds. Needles of less than three characters read all files. Filters lose their use
where a file has nearly all trigrams: rows that lie together by source or time, in files of moderate size, keep them apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators.query import find_by_text

#: Positions of a filter, in bitmaps of 32,768.
BITS, BITMAP = 1 << 18, 1 << 15
#: Filters that a task has open.
OPEN = 256


def _positions(text: bytes) -> np.ndarray:
    """Positions of a lower-cased text's trigrams, from 0."""
    x = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    return ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(14)


def build(spark: SparkSession, table: str, path: str, fields: tuple[str, ...] = ("instruction", "response")) -> DataFrame:
    """file, bucket, bits: the filters of the table's files, written to `path`."""
    whole = spark.read.parquet(table)
    rows = whole.select(F.col("_metadata.file_path").alias("file"), *(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).cast("binary").alias(f"t{k}") for k, f in enumerate(fields)))

    def of(held):
        names, buckets, bits = [], [], []
        for file, on in held.items():
            for k in np.flatnonzero(on.reshape(-1, BITMAP).any(axis=1)).tolist():
                names.append(file)
                buckets.append(k + 1)
                bits.append(np.packbits(on[k * BITMAP : (k + 1) * BITMAP], bitorder="little").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(buckets, pa.int64()), pa.array(bits, pa.binary())], names=["file", "bucket", "bits"])

    def run(batches):
        held = {}
        for b in batches:
            for file in b.column(0).unique().to_pylist():
                if len(held) >= OPEN and file not in held:
                    yield of(held)
                    held = {}
                on = held.setdefault(file, np.zeros(BITS, dtype=bool))
                part = b.filter(pc.equal(b.column(0), file))
                for k in range(1, b.num_columns):
                    for text in part.column(k):
                        on[_positions(text.as_buffer())] = True
        yield of(held)

    bits = rows.mapInArrow(run, "file string, bucket long, bits binary").groupBy("file", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    bits.write.mode("overwrite").parquet(path)
    files = whole.select(F.col("_metadata.file_path").alias("file")).distinct()  # a file without trigrams has no bitmap
    files.write.mode("overwrite").parquet(f"{path}-files")
    return spark.read.parquet(path)


def may_hold(spark: SparkSession, path: str, needle: str) -> tuple[list[str], int]:
    """The files that may hold the needle, and how many files there are."""
    files = [r.file for r in spark.read.parquet(f"{path}-files").orderBy("file").collect()]  # names of files
    if len(needle.lower()) < 3:
        return files, len(files)
    asked = np.unique(_positions(spark.range(1).select(F.lower(F.lit(needle)).cast("binary")).first()[0]).astype(np.int64))
    held, n = None, 0
    index = spark.read.parquet(path)
    for bucket in np.unique(asked // BITMAP).tolist():
        ok = F.lit(True)
        for at in (asked[asked // BITMAP == bucket] % BITMAP).tolist():
            byte = F.conv(F.hex(F.substring("bits", at // 8 + 1, 1)), 16, 10).cast("int")
            ok = ok & (byte.bitwiseAND(1 << at % 8) != 0)
        one = index.where((F.col("bucket") == bucket + 1) & ok).select("file")
        held, n = (one if held is None else held.unionByName(one)), n + 1
    found = held.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n).select("file").orderBy("file").collect()
    return [r.file for r in found], len(files)


def search(spark: SparkSession, table: str, path: str, needle: str, fields: tuple[str, ...] = ("instruction", "response"), case_sensitive: bool = False) -> tuple[DataFrame, int, int]:
    """The table's rows that hold the needle, how many files are read for them, and how many there are."""
    files, total = may_hold(spark, path, needle)
    whole = spark.read.parquet(table)
    rows = spark.read.schema(whole.schema).parquet(*files) if files else whole.limit(0)
    return find_by_text(rows, needle, fields, case_sensitive), len(files), total
