"""Operator 4: URL filter by a blocked Bloom filter and an exact hash join.

The list holds canonical URL prefixes: a host (which also stands for its subdomains) and the start of a path, each with
a verdict. A URL has one probe key for each pair of a host suffix, cut at dots, and a path prefix whose length occurs in
the list. Probes test a split-block Bloom filter (256-bit blocks, one bit in each of eight 32-bit words); what passes
goes to an exact hash join on the key, which removes false positives, and the longest entry wins. URLs without an entry
get the default verdict.

The filter is a table (block, eight words) built by bit_or, of 32 bytes a block. It is broadcast only while its proven
size, blocks x 80 bytes, is below `BROADCAST_BYTES`; beyond, the probes are shuffled to its blocks. The list joins as
Spark finds best, by its own size threshold. Probes of one URL are formed in place, the winner is taken with one
aggregation by URL, pre-aggregated before the shuffle. Distinct URLs are judged once; the winners are written before the
pages join them, so that AQE may broadcast them or split a URL that many pages share. DataFrame functions only.

Defined cases: a null URL or one without `://` has an empty host and path and gets the default verdict; an empty path
only matches entries with an empty path; entries with a null host or path count as empty there; of entries with one key
and different verdicts, block wins; an empty list gives the default everywhere; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS_PER_KEY = 16
BROADCAST_BYTES = 8 << 20
#: Host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _small(host: Column) -> Column:
    """A-Z lower-cased, and no other letter, for hosts of pages and of the list alike."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return _small(host), path


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """One bit of 32 for each of the eight words, 5 bits of a second hash each."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 5 * i).bitwiseAND(F.lit(31).cast("long")).cast("int")) for i in range(8)]


def build(keys: DataFrame, blocks: int) -> DataFrame:
    """The Bloom filter of the column `key`: block, w0..w7."""
    marked = keys.select(_block(F.col("key"), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("key")))])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (the entry that decided, else null), verdict; listed: host, path, verdict."""
    spark = pages.sparkSession
    entries = listed.select(_small(F.coalesce("host", F.lit(""))).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "verdict")
    entries = entries.groupBy("h", "p").agg(F.when(F.max(F.col("verdict") == "block"), "block").otherwise(F.min("verdict")).alias("verdict"))
    entries = entries.select(F.concat("h", "p").alias("rule"), F.concat_ws("\x01", "h", "p").alias("key"), F.length("h").alias("h_len"), F.length("p").alias("p_len"), "verdict")
    entries = common.written(entries, common.scratch(spark, "url-list"))
    n, lengths, depths = entries.agg(
        F.count(F.lit(1)), F.collect_set("p_len"), F.collect_set(F.size(F.split(F.element_at(F.split("key", "\x01"), 1), r"\.")))
    ).first()
    blocks = 1 << max(0, math.ceil(math.log2(max(1, n) * BITS_PER_KEY / 256)))
    # written, since an aggregate ties a join to its keys and keeps AQE from splitting a block that many probes reach
    bloom = common.written(build(entries, blocks), common.scratch(spark, "url-bloom"))
    if blocks * 80 <= BROADCAST_BYTES:
        bloom = F.broadcast(bloom)

    host, path = host_path(F.col("url"))
    urls = pages.select(F.col(url_col).alias("url")).distinct().select("url", host.alias("host"), path.alias("path"))
    label = F.split("host", r"\.")
    suffixes = F.filter(
        F.transform(F.array(*[F.lit(d) for d in sorted(depths)]) if depths else F.array().cast("array<int>"), lambda d: F.when(F.size(label) >= d, F.array_join(F.slice(label, F.size(label) - d + 1, d), "."))),
        lambda s: s.isNotNull(),
    )
    starts = F.filter(
        F.transform(F.array(*[F.lit(k) for k in sorted(lengths)]) if lengths else F.array().cast("array<int>"), lambda k: F.when(F.length("path") >= k, F.substring(F.col("path"), F.lit(1), k))),
        lambda s: s.isNotNull(),
    )
    probes = urls.where("host != ''").select("url", F.explode(suffixes).alias("s"), starts.alias("starts"))
    probes = probes.select("url", F.explode(F.transform("starts", lambda p: F.concat_ws("\x01", F.col("s"), p))).alias("key"))
    probes = probes.withColumn("block", _block(F.col("key"), blocks))
    tested = probes.join(bloom, "block")
    for i, m in enumerate(_masks(F.col("key"))):
        tested = tested.where(F.col(f"w{i}").bitwiseAND(m) != 0)
    hits = tested.select("url", "key").join(entries, "key")
    best = hits.groupBy("url").agg(F.max(F.struct(F.col("h_len") + F.col("p_len"), "h_len", "rule", "verdict")).alias("best"))
    # written, since an aggregate ties a join to its keys and keeps AQE from splitting a URL of many pages
    best = common.written(best, common.scratch(spark, "url-best"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_path(F.col("url"))
    return rows.join(best, "url", "left").select(
        "page_id", host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.range(1).select(F.inline(F.array(*[F.struct(*map(F.lit, r)) for r in RULES]))).toDF("host", "path", "verdict")
    return judge(common.table(spark, sf_dir, "pages"), listed)


SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM cut),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                          ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""
