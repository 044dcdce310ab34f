"""Keys that hold a third of all rows and more."""

import pytest
from pyspark.sql import functions as F

from quillmill.llm import url_filter, warc
from quillmill.plans.scratch import scratch

SPLIT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
}


@pytest.fixture
def splitting(spark):
    before = {k: spark.conf.get(k, None) for k in SPLIT}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_url_of_most_pages_is_split(spark, splitting):
    url = F.when(F.col("id") % 5 > 0, "http://www.example.org/es/1").otherwise(F.concat(F.lit("http://x.com/fr/"), F.col("id")))
    pages = spark.range(0, 40_000, 1, 8).select(F.col("id").alias("page_id"), F.when(F.col("id") % 7 > 0, url).alias("url"))
    listed = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    out = url_filter.judge(pages, listed)
    assert "SortMergeJoin(skew=true)" in plan(out)
    got = {(r.rule, r.verdict): r["count"] for r in out.groupBy("rule", "verdict").count().collect()}
    null, most = 5715, sum(1 for k in range(40_000) if k % 7 and k % 5)
    assert got == {(None, "allow"): null, ("example.org/es/", "block"): most, ("com/fr/", "allow"): 40_000 - null - most}


def test_long_urls(spark):
    long = "http://" + "a." * 2000 + "example.org/es/" + "p" * 500_000
    pages = spark.createDataFrame([(1, long), (2, long + "?q"), (3, "://" + "x" * 100_000)], "page_id long, url string")
    listed = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = {r.page_id: (len(r.host), len(r.path), r.rule, r.verdict) for r in url_filter.judge(pages, listed).collect()}
    assert got == {1: (4011, 500_004, "example.org/es/", "block"), 2: (4011, 500_004, "example.org/es/", "block"), 3: (100_000, 0, None, "allow")}


def test_a_payload_of_most_pages(spark, splitting):
    body = F.when(F.col("id") % 5 > 0, "z" * 1200).otherwise(F.repeat(F.col("id").cast("string"), 300))
    pages = spark.range(0, 4000, 1, 4).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), body.alias("html"))
    warc.write(pages, folder := scratch(spark, "warc-test"))
    got = {(r.record_type, r.refers_to): r["count"] for r in warc.read(spark, folder).groupBy("record_type", "refers_to").count().collect()}
    assert got == {("revisit", 3999): 3199, ("response", None): 801}
