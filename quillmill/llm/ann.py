"""Operator 8: approximate nearest neighbours by forests of sorted hash strings.

Rows are dealt evenly, by a hash, to blocks of `BLOCK_BYTES`. A block holds `TREES` trees; a tree is the
sorted array of its rows' hash strings, `BITS` signs of random projections each. A query descends in every tree to its
longest prefix match by binary search. Then all trees ascend together, one bit at a time, until the rows under the
prefixes, counted over all trees, reach `QUOTA` of the block's rows; these are the candidates, compared by exact cosine. A query left with fewer than k goes up to the root.
The quota is a share of the block, so recall doesn't fall with size: the test rows are nearly isotropic in 64 dimensions,
where five neighbours stand out little, and need half of a block or more seen for a recall safely above 0.9 (see the README).

Blocks and queries, in chunks of `CHUNK_BYTES`, are written to the shared folder once. A task takes one chunk through one
group of blocks: it builds each block's forest in turn and keeps the chunk's nearest so far. There are `GROUPS` groups of
blocks at most, so a query vector sends on k thin rows from each of them at most, whatever the number of blocks: what is
shuffled grows with the queries, not with queries times blocks. The comparisons do grow with both, as a quota by share
demands. Memory is bounded by a block and a chunk, and no bucket of any tree leaves its block, so no hash value can make
a task large. Of equal vectors only the k + 1 smallest ids can be among a query's k nearest with
ties to the smaller id, so all others are left out before the blocks are built, by a group limit that runs before the shuffle;
all rows are searched for, exactly.

Defined cases: vectors that are null, empty, zero, or have null or non-finite components take no part, neither as
queries nor as candidates; vectors of different lengths don't meet; rows without an id take no part; rows that repeat
id and vector are one; rows that share an id and differ in vector are candidates each, so an id may come twice in a
result; a query with several vectors under its id gets the nearest to any of them; ties go to the smaller id; vectors are
scaled by powers of two first, so finite ones of any size have a score; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TREES = 48
BITS = 32
BLOCK_BYTES = 64 << 20
CHUNK_BYTES = 16 << 20
GROUPS = 64
#: Tasks of a small input: chunks are cut smaller for as many, but not below so many queries.
TASKS, LEAST = 16, 256
QUOTA = 0.8
NEAREST = 5
SEED = 97


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int = TREES, seed: int = SEED):
        self.trees = trees
        self.planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], trees * BITS)).astype(np.float32)
        codes = self.strings(vectors)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """trees x rows hash strings, the first projection's sign as the highest bit."""
        out = np.empty((self.trees, len(vectors)), dtype=np.uint32)
        for at in range(0, len(vectors), 4096):
            signs = vectors[at : at + 4096].astype(np.float32) @ self.planes > 0
            words = np.packbits(signs.reshape(len(signs), self.trees, BITS), axis=2).view(">u4")[:, :, 0]
            out[:, at : at + 4096] = words.T
        return out

    def candidates(self, queries: np.ndarray, quota: float):
        """For each query the numbers of its candidate rows."""
        codes, n = self.strings(queries), self.sorted.shape[1]
        need, done = min(max(quota * n, 64), n * self.trees), np.zeros(len(queries), dtype=bool)
        low, high = np.zeros(codes.shape, dtype=np.int64), np.zeros(codes.shape, dtype=np.int64)
        for depth in range(min(BITS, int(np.log2(max(2, n))) + 6), -1, -1):
            todo = np.flatnonzero(~done)
            if not len(todo):
                break
            rest = np.uint32((1 << (BITS - depth)) - 1)
            for t in range(self.trees):
                c = codes[t, todo]
                low[t, todo] = np.searchsorted(self.sorted[t], c & ~rest, side="left")
                high[t, todo] = np.searchsorted(self.sorted[t], c | rest, side="right")
            done[todo] = (high[:, todo] - low[:, todo]).sum(axis=0) >= need
        seen = np.zeros(n, dtype=bool)
        for q in range(len(queries)):
            seen[:] = False
            for t in range(self.trees):
                seen[self.order[t, low[t, q] : high[t, q]]] = True
            yield np.flatnonzero(seen)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component below 1: no square overflows or vanishes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


class Block:
    """Rows of one length, searched through their forest. Vectors are scaled."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        self.ids, self.rows, self.vectors, self.forest = ids, rows, vectors, Forest(vectors)
        self.norm = np.sqrt((vectors * vectors).sum(axis=1))

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, quota: float) -> Iterator[Found]:
        """For each query vector the k nearest of the block's candidates."""
        ids, vectors, norm = self.ids, self.vectors, self.norm
        for i, own, q in zip(self.forest.candidates(queries, quota), query_ids, queries, strict=True):
            i = i[ids[i] != own]
            if len(i) < k:  # up to the root
                i = np.flatnonzero(ids != own)
            rough = (vectors[i] @ q) / norm[i]
            if len(i) > k:
                i = i[rough >= np.partition(rough, len(i) - k)[len(i) - k] - 1e-9 * np.sqrt(q @ q)]
            score = (vectors[i] * q).sum(axis=1) / (norm[i] * np.sqrt((q * q).sum()))  # alike for equal vectors
            yield _best((ids[i], self.rows[i], score), k)


#: vec_id, row, score of some rows.
Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def _best(found: Found, k: int) -> Found:
    order = np.lexsort((found[0], -found[2]))[:k]
    return tuple(c[order] for c in found)


def _vectors(batches) -> dict[int, list[np.ndarray]]:
    """By length of the vectors: ids, row keys and scaled vectors of batches (id, row, v)."""
    parts: dict[int, list] = {}
    for b in batches:
        (ids, rows), lists = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)), b.column(2)
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy())
        dims = np.diff(ends, prepend=0)
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            parts.setdefault(int(d), []).append((ids[at], rows[at], scaled(flat[(ends[at] - d)[:, None] + np.arange(d)])))
    return {d: [np.concatenate(c) for c in zip(*p, strict=True)] for d, p in parts.items()}


def _stream(folder: str) -> Iterator[pa.RecordBatch]:
    """The batches of a written table, which a task reads by itself; none if it isn't there."""
    fs, root = pafs.FileSystem.from_uri(folder)
    for f in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".parquet")):
        with fs.open_input_file(f) as source:
            yield from pq.ParquetFile(source).iter_batches(2048, columns=["id", "row", "v"])


def search(
    rows: DataFrame, queries: DataFrame, k: int = NEAREST, quota: float = QUOTA, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score; rows and queries have an id and a vector."""

    def sound(df: DataFrame) -> DataFrame:
        v = F.col(vec_col).cast("array<double>")
        df = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        df = df.where(finite & F.exists("v", lambda x: x != 0)).withColumn("same", F.sha2(F.to_json(F.struct("v")), 256))
        return df.dropDuplicates(["id", "same"]).withColumn("row", F.xxhash64("id", "same"))

    def dealt(df: DataFrame, parts: int, name: str, folder: str) -> None:
        """Written to one folder for each part, by a hash of the row."""
        df = df.select("id", "row", "v", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias(name))
        df.repartitionById(parts, name).write.partitionBy(name).parquet(folder)

    spark = rows.sparkSession
    first = Window.partitionBy("same").orderBy("id")
    base = sound(rows).withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1)
    base = common.written(base.select("id", "row", "v"), raw := common.scratch(spark, "ann-rows"))
    asked = common.written(sound(queries).select("id", "row", "v"), raw_asked := common.scratch(spark, "ann-asked"))
    (_, numbers), (n, asked_numbers) = (df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first() for df in (base, asked))
    blocks = max(1, -(-8 * numbers // BLOCK_BYTES))
    groups = min(blocks, GROUPS)
    chunks = max(1, -(-8 * asked_numbers // CHUNK_BYTES), min(-(-TASKS // groups), n // LEAST))
    dealt(base, blocks, "block", of_blocks := common.scratch(spark, "ann-blocks"))
    dealt(asked, chunks, "chunk", of_chunks := common.scratch(spark, "ann-chunks"))
    for folder in (raw, raw_asked):
        common.remove(spark, folder)

    def run(batches):
        for b in batches:
            for task in b.column(0).to_pylist():
                chunk, group = divmod(task, groups)
                asks = _vectors(_stream(f"{of_chunks}/chunk={chunk}"))
                nothing = tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.float64))
                found = {d: [nothing] * len(ids) for d, (ids, _, _) in asks.items()}
                for block in range(group, blocks, groups) if asks else ():
                    for d, held in _vectors(_stream(f"{of_blocks}/block={block}")).items():
                        if d in asks:
                            ids, _, v = asks[d]
                            for j, more in enumerate(Block(*held).nearest(ids, v, k, quota)):
                                found[d][j] = _best(tuple(map(np.concatenate, zip(found[d][j], more, strict=True))), k)
                for d, (ids, _, _) in asks.items():
                    of = np.repeat(ids, [len(f[0]) for f in found[d]])
                    yield pa.RecordBatch.from_arrays([pa.array(of), *(pa.array(np.concatenate(c)) for c in zip(*found[d], strict=True))], names=["query_id", "vec_id", "row", "score"])

    tasks = spark.range(0, chunks * groups, 1, chunks * groups)
    found = tasks.mapInArrow(run, "query_id long, vec_id long, row long, score double")
    # a row that several vectors of a query found counts once, by its best score
    found = found.groupBy("query_id", "vec_id", "row").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0))
