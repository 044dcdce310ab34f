"""Operator 12: audit of how filters interact, with duplicates by partition refinement.

Each row gets a mask of the filters it fails. Four of them look at the row's own text. The fifth, E, fails a row whose text
is also that of a smaller identifier anywhere in the table, and is found by refining a partition of the rows: first by length
in code points, then by the hash of one block of the text after another (`BLOCK` code points, then `GROWTH` times as many
each), chained with those before it. Rows alone in their class drop out after every step; a class whose texts are at an end
is final. Full texts are then compared: a final class whose least and greatest text are equal, as aggregates that combine
before the shuffle, holds copies of one text, and its rows but those of the least identifier fail. A class that isn't so,
by a collision of hashes, is grouped by the texts themselves.

Masks are counted per part; what a filter removes, alone, first or in any order, depends on these counts only. With
kept(S) the rows of a part that fail none of the filters in S, all 600 rows of a part are differences of its 32 values of
kept: a filter at its step removes kept(those before) - kept(those and it), and its Shapley total weighs these over all S
by the number of orders in which S comes before it. So the data is read twice, a text moves once at most, copies of it
only once a task, and counts are combined before the shuffle, whatever part or class is hot.

Defined cases: a null text is empty, a null part the empty string; a null identifier neither fails E nor makes another
row fail it; rows that share an identifier are each counted, are good or toxic if any label of the identifier says so, and
don't fail E by one another; an empty table has no parts and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The filters' letters and limits, and the white space between words.
FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 50, 65, 5, r"[#$%&*|]"

BLOCK = 256
GROWTH = 8


def block_hashes(text: Column, length: Column, block: int = BLOCK) -> Column:
    """The chained hashes of a text's blocks, as many as it takes to reach its end; the first link is the length."""

    def start(k: Column) -> Column:  # blocks before it hold block * (1 + GROWTH + ...) code points
        return (F.pow(F.lit(float(GROWTH)), k) - 1) / (GROWTH - 1) * block

    n = F.greatest(F.lit(1), F.ceil(F.log(float(GROWTH), length * (GROWTH - 1) / F.lit(float(block)) + 1) - 1e-9)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(text, (start(k) + 1).cast("int"), (F.pow(F.lit(float(GROWTH)), k) * block).cast("int")))
    return F.aggregate(blocks, F.array(F.xxhash64(length)), lambda done, b: F.concat(done, F.array(F.xxhash64(F.element_at(done, -1), b))))


def final_keys(rows: DataFrame, folders: list[str]) -> DataFrame:
    """key, first: of classes of two rows or more that no block parts, with their least identifier. rows: doc_id, chain."""
    spark, step, out = rows.sparkSession, 0, None
    alive = rows.where("doc_id is not null")
    while True:
        key = F.element_at("chain", step + 1)
        sizes = alive.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max(F.size("chain")).alias("blocks"))
        folders.append(common.scratch(spark, "audit-classes"))
        classes = common.written(sizes.where("n > 1"), folders[-1])  # written, so that AQE may split the join with a hot class
        done = classes.where(F.col("blocks") == step + 1).select("key", "first")
        out = done if out is None else out.unionByName(done)
        more = classes.where(F.col("blocks") > step + 1).select("key")
        if not more.take(1):
            return out
        alive = alive.where(F.size("chain") > step + 1).withColumn("key", key).join(more, "key", "left_semi").drop("key")
        folders.append(common.scratch(spark, "audit-alive"))
        alive = common.written(alive, folders[-1])
        step += 1


def _masked(rows: DataFrame) -> DataFrame:
    """rows with mask: the bits of A to D. Words are a column first, so that they are found once."""
    rows = rows.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != "")).withColumns({"n": F.size("words"), "distinct": F.size(F.array_distinct("words"))})
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [F.col("n") < MIN_WORDS, 100 * F.col("distinct") < MIN_DISTINCT * F.col("n"), 100 * capitals > MAX_CAPITALS * F.length("text"), F.col("text").rlike(SYMBOLS)]
    return rows.withColumn("mask", sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))).drop("words", "n", "distinct")


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", block: int = BLOCK, hashes=block_hashes) -> tuple[DataFrame, list[str]]:
    """doc_id, part, mask (bit k: fails the k-th filter), one row per row of docs; and the folders that it reads."""
    spark, folders = docs.sparkSession, []
    text, part = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, part_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), part.alias("part"))
    chain = hashes(F.col("text"), F.length("text"), block)
    folders.append(common.scratch(spark, "audit-rows"))
    thin = common.written(_masked(rows).select("doc_id", "part", "mask", chain.alias("chain")), folders[-1])
    keys = final_keys(thin.select("doc_id", "chain"), folders)
    # full texts of a class: copies combine before the shuffle
    held = rows.where("doc_id is not null").withColumn("key", F.element_at(chain, -1))
    compared = held.groupBy("key").agg((F.min("text") == F.max("text")).alias("equal"))  # before the join, which would deal a hot class to one task
    folders.append(common.scratch(spark, "audit-compared"))
    compared = common.written(keys.join(compared, "key"), folders[-1])
    bit = F.lit(1 << FILTERS.index("E")) * F.coalesce((F.col("doc_id") > F.col("first")).cast("int"), F.lit(0))
    marked = thin.where("doc_id is not null").withColumn("key", F.element_at("chain", -1)).join(compared, "key", "left")
    out = marked.where(F.coalesce("equal", F.lit(True))).select("doc_id", "part", (F.col("mask") + bit).alias("mask"))
    out = out.unionByName(thin.where("doc_id is null").select("doc_id", "part", "mask"))
    # classes of several texts: grouped by the texts themselves
    apart = compared.where("not equal").select("key")
    if apart.take(1):
        odd = held.join(apart, "key", "left_semi")
        firsts = odd.groupBy("key", "text").agg(F.min("doc_id").alias("first"))
        out = out.unionByName(_masked(odd.join(firsts, ["key", "text"])).select("doc_id", "part", (F.col("mask") + bit).alias("mask")))
    return out, folders


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", block: int = BLOCK, hashes=block_hashes
) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: for each part, all
    orders of the filters and each step of them."""
    spark = docs.sparkSession
    rows, folders = masks(docs, id_col, text_col, part_col, block, hashes)
    said = labels.select(F.col(id_col).alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    said = said.where("doc_id is not null and (good or toxic)").groupBy("doc_id").agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("good", "toxic")))
    counted = rows.join(said, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(c) for c in ("good", "toxic")))
    counted = common.written(counted, common.scratch(spark, "audit-counts"))  # read by the result: at most 32 rows a part
    for f in folders:
        common.remove(spark, f)

    k, full = len(FILTERS), 1 << len(FILTERS)
    total = lambda when, c: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    free = [F.array(*(total(F.col("mask").bitwiseAND(s) == 0, c) for s in range(full))).alias(c) for c in ("n", "good", "toxic")]
    parts = counted.groupBy("part").agg(*free, F.array(*(total(F.col("mask") == 1 << j, "n") for j in range(k))).alias("alone"))
    n, ways = F.col("n"), [math.factorial(j) * math.factorial(k - 1 - j) for j in range(k)]
    worth = [sum(((n[s] - n[s | 1 << j]) * ways[s.bit_count()] for s in range(full) if not s >> j & 1), F.lit(0)) for j in range(k)]
    parts = parts.select("*", F.array(*(n[0] - n[1 << j] for j in range(k))).alias("failing"), F.array(*worth).alias("worth"))

    orders = F.explode(F.array(*map(F.lit, map("".join, itertools.permutations(FILTERS))))).alias("filter_order")
    steps = parts.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    own = F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1)))

    def upto(last: Column) -> Column:
        """Where the arrays hold what none of an order's first filters fails."""
        first = F.substring("filter_order", F.lit(1), last)
        return sum((F.contains(first, F.lit(c)).cast("int") * (1 << j) for j, c in enumerate(FILTERS)), F.lit(1))

    steps = steps.withColumns({"own": own, "before": upto(F.col("step") - 1), "after": upto(F.col("step"))})
    lost = lambda c: F.element_at(c, F.col("before")) - F.element_at(c, F.col("after"))
    mine = lambda c: F.element_at(c, F.col("own"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        F.element_at("n", F.col("after")).alias("kept"),
        lost("n").alias("removed"),
        (mine("failing") - lost("n")).alias("redundant"),
        mine("alone").alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        mine("worth").alias("shapley"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
f AS (SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
  regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || x.c || y.c || z.c AS o FROM c a, c b, c x, c y, c z WHERE len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5),
m AS (SELECT *, list_transform([1, 2, 3, 4, 5], lambda k: fails[strpos('ABCDE', substr(o, k, 1))]) AS r FROM g, o),
s AS (SELECT part, o, step, n, good, toxic, r[step] AS hit, list_contains(r[1:step - 1], true) AS gone, len(list_filter(r, lambda v: v)) AS total FROM m, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
e AS (SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, sum(CASE WHEN hit OR gone THEN 0 ELSE n END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN hit AND total = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM e"""
