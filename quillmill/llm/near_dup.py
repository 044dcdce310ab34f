"""Operator 7: near-duplicate groups by a chosen-path similarity join on word shingles.

Documents become sets of hashed 5-word shingles (64 bits). Equal sets form classes first; one document stands for its
class. `TREES` independent trees then branch the classes: a node picks one, at times two, of the min-wise functions by a
hash of its path (2 with probability `SECOND`, so that a pair at the threshold survives each level about once on
average) and deals its members out by the least value. Nodes of up to `SMALL` classes are compared exhaustively on the
full sets; larger ones branch again. A node whose members hardly part (`DENSE`), or that is left after `LEVELS`, is
compared whole: first with `PIVOTS` of its members, and what the links with them leave open (by the triangle inequality of
1 - similarity) in pairs of blocks of `BLOCK` members and `BLOCK_BYTES` at most, each a task of its own. So a family of near
copies costs a few comparisons a member, and no task grows with a group; only members of a dense node that are linked with
no pivot, or lie between stars, meet in all pairs. A pair of
similarity s meets in the first level of one of T trees with probability 1 - (1 - s)^T, above 0.9999999 at s = 0.85 and
T = 12; deeper levels are only reached where many documents share their least values.

A block emits the spanning forest of its links, not the pairs, and every link is confirmed on the full sets. Shingles are
64-bit hashes throughout, so two shingles count as one if their hashes are equal (by chance once in 10^19 pairs). Nodes with
the same members in several trees are compared once. Components come from the distributed star algorithm.

Defined cases: null and empty texts, and texts without words, have the empty set, are linked with nothing and stay;
fewer words than five make one shingle of the whole sequence; a row without an id takes no part, has a null component
and stays; rows that repeat an id with one text are alike; in `groups`, rows that share an id count as one vertex, which
has the links of all their texts, while `keep_one` decides by texts; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.operators.components import components

from . import common

WORDS = 5
PERCENT = 85
TREES = 12
FUNCTIONS = 96
SMALL = 128
SECOND = 0.4
DENSE = 0.8
LEVELS = 10
BLOCK = 512
BLOCK_BYTES = 32 << 20
PIVOTS = 16
HASH_JOIN, HASH_BYTES = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles. Bytes split at ASCII white space, A-Z lower-cased."""
    found = (text or "").encode("utf-8").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    out = h[: len(h) - words + 1].copy()
    for k in range(1, words):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : len(h) - words + 1 + k]
    return np.unique(_mix(out))


def _functions(n: int) -> np.ndarray:
    return np.random.default_rng(71).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least(hashes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The least value of each min-wise function over a set."""
    out = np.full(len(odd), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        x = hashes[at : at + 4096, None] * odd[None, :]
        np.minimum(out, (x ^ (x >> np.uint64(32))).min(axis=0), out=out)
    return out


def _prints(rows: DataFrame, words: int, trees: int) -> DataFrame:
    """doc_id, mark, n_shingles, digest, keys: the first level's nodes."""
    odd = _functions(trees)
    tree = _mix(np.arange(1, trees + 1, dtype=np.uint64))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                sets = [shingles(t, words) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([_mix(least(s, odd) ^ tree).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "mark", "n_shingles", "digest", "keys"],
                )

    return rows.mapInArrow(run, "doc_id long, mark long, n_shingles long, digest binary, keys array<long>")


def _sets(rows: DataFrame, words: int, functions: int) -> DataFrame:
    """rep, hashes (the set), least (its min-wise values): of rows whose set has the class's digest, once a task."""
    odd = _functions(functions)

    def run(batches):
        seen = set()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256).to_pydict()
                out = [(r, s) for r, t, d in zip(part["rep"], part["text"], part["digest"], strict=True) if xxhash.xxh3_128_digest((s := shingles(t, words)).tobytes()) == d and r not in seen and not seen.add(r)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r for r, _ in out], pa.int64()),
                        pa.array([s.tobytes() for _, s in out], pa.binary()),
                        pa.array([least(s, odd).view(np.int64) for _, s in out], pa.list_(pa.int64())),
                    ],
                    names=["rep", "hashes", "least"],
                )

    return rows.mapInArrow(run, "rep long, hashes binary, least array<long>")


def links(sets: list[np.ndarray], percent: int, sides: list[int] | None = None, stars: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links of some sets; with sides, of links between the two sides only; sets of one star (-1:
    of none) are known to be in one component and not linked."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    if n == 2:
        both = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))]] * 2)
    else:
        value, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
        _, column, count = np.unique(value, return_inverse=True, return_counts=True)
        rank = np.cumsum(count > 1) - 1  # columns that two sets share
        shared = count[column] > 1
        owner, column = owner[shared], rank[column[shared]]
        both, order = np.zeros((n, n)), np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
            lo, hi = np.searchsorted(column, [at, at + 8192])
            m = np.zeros((n, int(column[hi - 1]) - at + 1), dtype=np.float32)
            m[owner[lo:hi], column[lo:hi] - at] = 1
            both += m @ m.T
    linked = np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1) & (both > 0)
    if sides is not None:
        s = np.array(sides)
        linked &= s[:, None] != s[None, :]
    if stars is not None:
        s = np.array(stars)
        linked &= (s[:, None] != s[None, :]) | (s[:, None] < 0)
    root, out = list(range(n)), []

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in zip(*map(np.ndarray.tolist, np.nonzero(linked)), strict=True):
        x, y = top(a), top(b)
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


def _runs(batches, columns: list[str]):
    """Rows of batches as tuples of the columns, those of equal first column as one list."""
    of, held = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            if row[0] != of and held:
                yield held
                held = []
            of = row[0]
            held.append(row)
    if held:
        yield held


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["src", "dst"])


def _compared(rows: DataFrame, percent: int) -> DataFrame:
    """Links of tasks, whose rows (task, cross, side, star, rep, hashes) lie together in each partition."""

    def run(batches):
        for held in _runs(batches, ["task", "cross", "side", "star", "rep", "hashes"]):
            if len(held) > 1:
                _, cross, sides, stars, reps, hashes = zip(*held, strict=True)
                found = links([np.frombuffer(h, dtype=np.uint64) for h in hashes], percent, sides if cross[0] else None, stars)
                yield _pairs([(reps[a], reps[b]) for a, b in found if reps[a] != reps[b]])

    return rows.mapInArrow(run, "src long, dst long")


def _beside_pivots(rows: DataFrame, percent: int) -> DataFrame:
    """node, rep, n, star (the first pivot linked, -1: none), joined (further pivots linked), near (pivots that anything linked
    with the row may be linked with). Rows: task, node, pivot (its number; null for members), rep, n, hashes; in each
    partition, a task's pivots come before its members, which are held one at a time."""

    def run(batches):
        task, pivots, out = None, [], []

        def index():
            values, owner = np.concatenate(pivots), np.repeat(np.arange(len(pivots)), [len(p) for p in pivots])
            values, at = np.unique(values, return_inverse=True)
            holds = np.zeros((len(values), len(pivots)), dtype=np.int32)
            holds[at, owner] = 1
            return values, holds, np.array([len(p) for p in pivots])

        def batch():
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["node", "rep", "n", "star", "joined", "near"])

        for b in batches:
            for t, node, pivot, rep, n, hashes in zip(*(b.column(c).to_pylist() for c in ("task", "node", "pivot", "rep", "n", "hashes")), strict=True):
                if t != task:
                    task, pivots, values = t, [], None
                x = np.frombuffer(hashes, dtype=np.uint64)
                if pivot is not None:
                    pivots.append(x)
                    continue
                if values is None:
                    values, holds, sizes = index()
                at = np.minimum(np.searchsorted(values, x), len(values) - 1)
                both = holds[at[values[at] == x]].sum(axis=0)
                union = sizes + len(x) - both
                linked = np.flatnonzero((100 * both >= percent * union) & (both > 0)).tolist()
                # 1 - similarity is a metric: what is linked with both lies within two of its bounds
                near = np.flatnonzero(100 * both >= (2 * percent - 100) * union).tolist()
                out.append((node, rep, n, linked[0] if linked else -1, linked[1:], near))
            yield batch()
            out = []

    return rows.mapInArrow(run, "node long, rep long, n long, star int, joined array<int>, near array<int>")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _labels(pairs: pa.Array) -> pa.Array:
    """The least pivot of each pivot's component, of pairs as a * PIVOTS + b."""

    def of(found):
        label = list(range(PIVOTS))
        for x in found:
            a, b = sorted((label[x // PIVOTS], label[x % PIVOTS]))
            label = [a if k == b else k for k in label]
        return label

    return pa.array(map(of, pairs.to_pylist()), pa.list_(pa.int32()))


def _contracted(large: DataFrame, sets: DataFrame, percent: int, keep) -> tuple[DataFrame, DataFrame]:
    """Links of members with their node's pivots, and the members (node, rep, n, star) left to compare with each other.

    Members linked with pivots of one component need no further comparison among them; a pair of two stars, or of a star
    and a member of none, can only be linked if each is near a pivot of the other's star. The nodes of a family, one or more
    in each tree, nearly always share their member of least hash: nodes with one such lead are taken together first."""
    lead = F.min(F.struct(F.xxhash64("rep").alias("hash"), "rep"))["rep"]
    lead = keep(large.groupBy("node").agg(lead.alias("lead")), "leads")
    large = keep(large.join(lead, "node").select(F.col("lead").alias("node"), "rep", "n").distinct(), "families")
    of_node = keep(large.groupBy("node").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks")), "family-sizes")
    large = keep(large.join(of_node, "node"), "large")
    order = Window.partitionBy("node").orderBy(F.xxhash64("rep", "node"), "rep")
    pivots = large.withColumn("pivot", F.row_number().over(order) - 1).where(F.col("pivot") < PIVOTS)
    pivots = keep(pivots.select("node", "rep", "n", "blocks", "pivot"), "pivots")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = pivots.select("node", "rep", "n", at.alias("block"), "pivot").unionByName(
        large.select("node", "rep", "n", F.pmod(F.xxhash64("rep", "node"), F.col("blocks")).alias("block"), F.lit(None).cast("int").alias("pivot"))
    )
    rows = rows.withColumn("task", F.xxhash64("node", "block")).join(sets.select("rep", "hashes"), "rep")
    found = keep(_beside_pivots(rows.repartition("task").sortWithinPartitions("task", F.asc_nulls_last("pivot")), percent), "beside")
    joined = found.select("node", "star", F.explode("joined").alias("other")).distinct()
    labels = joined.groupBy("node").agg(F.collect_set(F.col("star") * PIVOTS + F.col("other")).alias("pairs")).select("node", _labels("pairs").alias("labels"))
    by_pivot = pivots.select("node", F.col("pivot").alias("star"), F.col("rep").alias("dst"))
    links_ = found.where("star >= 0").select("node", F.col("rep").alias("src"), "star").join(by_pivot, ["node", "star"]).select("src", "dst")
    also = joined.join(by_pivot, ["node", "star"]).select("node", F.col("other").alias("star"), F.col("dst").alias("src")).join(by_pivot, ["node", "star"]).select("src", "dst")
    # written, so that AQE may split the joins with a node of many members
    labels = keep(large.select("node").distinct().join(labels, "node", "left"), "labels")
    label = lambda x: F.coalesce(F.element_at("labels", x + 1), x)
    found = found.join(labels, "node").withColumn("star", F.when(F.col("star") >= 0, label(F.col("star"))).otherwise(-1))
    found = found.withColumn("near", F.array_distinct(F.transform("near", label)))
    wanted = keep(found.where("star < 0").select("node", F.explode("near").alias("star")).distinct().withColumn("wanted", F.lit(True)), "wanted")
    found = found.join(wanted, ["node", "star"], "left")
    beside = F.size(F.filter("near", lambda x: x != F.col("star"))) > 0
    left = found.where((F.col("star") < 0) | beside | F.col("wanted")).select("node", "rep", "n", "star")
    return links_.unionByName(also), keep(left, "left")


def _sized(nodes: DataFrame) -> DataFrame:
    """node, size, total (of n), content: of nodes with two members or more. Partial counts go before the shuffle.

    Content is sums of hashes, which no repeated member cancels; as decimals, they don't overflow.
    """
    content = F.concat_ws(",", *[F.sum(F.xxhash64("rep", F.lit(k)).cast("decimal(20,0)")) for k in (0, 1)], F.count(F.lit(1)))
    return nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"), content.alias("content")).where("size > 1")


def _blocks(size: Column | str, total: Column | str) -> Column:
    """Blocks of a node of so many members and shingles."""
    size, total = (F.col(x) if isinstance(x, str) else x for x in (size, total))
    return F.greatest(F.ceil(size / BLOCK), F.least(F.ceil(8 * total / BLOCK_BYTES), size)).cast("long")


def _linked(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, trees: int) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """Prints of all rows; classes (rep, digest, id: the least of its rows); links of classes, src and dst; folders to remove."""
    spark = docs.sparkSession
    folders: list[str] = []

    def keep(df: DataFrame, tag: str) -> DataFrame:
        folders.append(common.scratch(spark, f"near-{tag}"))
        return common.written(df, folders[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))  # tells the texts of an id apart
    prints = common.written(_prints(rows, words, trees), common.scratch(spark, "near-prints"))  # read by the result
    classes = prints.where("n_shingles > 0 and doc_id is not null").groupBy("digest")
    classes = classes.agg(F.min(F.struct("doc_id", "mark")).alias("least"), F.first("keys").alias("keys"), F.first("n_shingles").alias("n"))
    # classes go by their digest, since an id may have several texts
    classes = keep(classes.select("digest", "keys", "n", F.col("least.doc_id").alias("id"), "least.mark", F.xxhash64("digest").alias("rep")), "classes")

    # the first level of all trees; then branch what is too large
    nodes = classes.select(F.explode("keys").alias("node"), "rep", "n")
    # sizes are written, so that both sides of a join with them are dealt anew and AQE may split a hot node
    members = keep(nodes.join(keep(_sized(nodes), "sizes"), "node"), "level")
    candidates = members.select("rep").distinct().join(classes.select("rep", "digest", F.col("id").alias("doc_id"), "mark"), "rep")
    before = spark.conf.get(HASH_JOIN)
    spark.conf.set(HASH_JOIN, HASH_BYTES)  # a hash join where all partitions of the candidates are that small, else by sorting
    try:
        sets = keep(_sets(rows.join(candidates, ["doc_id", "mark"]), words, FUNCTIONS), "sets")
    finally:
        spark.conf.set(HASH_JOIN, before)
    final = [members.where(F.col("size") <= SMALL)]
    large = members.where(F.col("size") > SMALL)
    for level in range(LEVELS):
        if not large.take(1):
            break
        n = FUNCTIONS - trees
        first, off = (F.pmod(F.xxhash64("node", F.lit(2 * level + k)), F.lit(m)) for k, m in ((0, n), (1, n - 1)))
        pick = [first + trees + 1, F.pmod(first + off + 1, F.lit(n)) + trees + 1]  # never the same
        twice = F.pmod(F.xxhash64("node", F.lit("second")), F.lit(1000)) < int(1000 * SECOND)
        at = F.explode(F.when(twice, F.array(*pick)).otherwise(F.array(pick[0])))
        below = large.withColumnRenamed("size", "above").withColumn("at", at).join(sets.select("rep", "least"), "rep")
        below = keep(below.select(F.xxhash64("node", "at", F.element_at("least", F.col("at").cast("int"))).alias("node"), "rep", "n", "above"), "level")
        members = keep(below.join(keep(_sized(below), "sizes"), "node"), "level")
        ends = (F.col("size") <= SMALL) | (F.col("size") > DENSE * F.col("above"))
        final.append(members.where(ends).drop("above"))
        large = members.where(~ends).drop("above")
    final.append(large)
    final = [f.select("node", "rep", "n", "size", "total", "content") for f in final]
    ready = final[0]
    for f in final[1:]:
        ready = ready.unionByName(f)
    ready = keep(ready, "nodes")
    once = ready.groupBy("content").agg(F.min("node").alias("node"))
    ready = keep(ready.join(once.select("node"), "node", "left_semi").withColumn("blocks", _blocks("size", "total")), "once")

    # members of large nodes are held against pivots first; blocks of what is left, a pair of blocks a task
    by_pivot, left = _contracted(ready.where("blocks > 1"), sets, percent, keep)
    of_node = keep(left.groupBy("node").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks")), "left-sizes")
    ready = ready.where("blocks = 1").select("node", "rep", F.lit(-1).alias("star"), "blocks")
    ready = ready.unionByName(left.join(of_node, "node").select("node", "rep", "star", "blocks"))
    ready = ready.withColumn("mine", F.pmod(F.xxhash64("rep", "node"), F.col("blocks")))
    ready = ready.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tasks = ready.select(
        F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"),
        (F.col("mine") != F.col("other")).alias("cross"),
        F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"),
        "star",
        "rep",
    )
    tasks = tasks.join(sets.select("rep", "hashes"), "rep").repartition("task").sortWithinPartitions("task")
    edges = keep(_compared(tasks, percent).unionByName(by_pivot), "links")
    return prints, classes, edges, folders


def groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, trees: int = TREES
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs."""
    spark = docs.sparkSession
    prints, classes, edges, folders = _linked(docs, id_col, text_col, words, percent, trees)
    for side in ("src", "dst"):
        edges = edges.join(classes.select(F.col("rep").alias(side), F.col("id").alias(f"{side}_id")), side)
    edges = edges.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")).where("src != dst")
    found = common.written(components(edges), at := common.scratch(spark, "near-components"))
    of_class = classes.join(found, classes["id"] == found["vertex"], "left").select("digest", F.coalesce("component", "id").alias("component"))
    of_class = common.written(of_class, common.scratch(spark, "near-of-class"))
    for f in [*folders, at]:
        common.remove(spark, f)

    out = prints.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    alone = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, trees: int = TREES) -> DataFrame:
    """The rows of docs that stay, all columns: one text of each group of linked texts, in its row of least id.

    Texts are what is linked here, not ids: of an id with unlike texts, each stays or goes by its own links. Rows that repeat
    an id and a text stay or go together; a row without an id stays."""
    spark = docs.sparkSession
    prints, classes, edges, folders = _linked(docs, id_col, text_col, words, percent, trees)
    found = common.written(components(edges.where("src != dst")), at := common.scratch(spark, "near-components"))
    linked = classes.join(found, classes["rep"] == found["vertex"], "left").select("digest", "id", F.coalesce("component", "rep").alias("component"))
    linked = common.written(linked, at_linked := common.scratch(spark, "near-linked"))
    stays = common.written(linked.groupBy("component").agg(F.min(F.struct("id", "digest")).alias("stays")), at_stays := common.scratch(spark, "near-stays"))
    of_class = common.written(linked.join(stays, "component").select("digest", "stays"), common.scratch(spark, "near-of-class"))
    for f in [*folders, at, at_linked, at_stays]:
        common.remove(spark, f)
    gone = prints.where("n_shingles > 0 and doc_id is not null").select("doc_id", "mark", "digest").join(of_class, "digest")
    gone = gone.where((F.col("digest") != F.col("stays.digest")) | (F.col("doc_id") != F.col("stays.id"))).select(F.col("doc_id").alias("__gone"), F.col("mark").alias("__mark")).distinct()
    left = docs.where(docs[id_col].isNotNull())
    same = (left[id_col].cast("long") == gone["__gone"]) & (F.xxhash64(left[text_col].cast("string")) == gone["__mark"])
    return left.join(gone, same, "left_anti").unionByName(docs.where(docs[id_col].isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents"))
