"""The test tables as sample tables, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.sources.records import to_samples


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, instruction, response, source_type, tags, quality_score, review_status."""
    d, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "flagged").otherwise("pending")
    return d.join(marks, "doc_id", "left").select(
        F.col("doc_id").alias("idx"),
        F.substring_index("text", "\n", 1).alias("instruction"),
        F.col("text").alias("response"),
        F.col("source").alias("source_type"),
        F.array("lang").alias("tags"),
        F.col("quality").cast("double").alias("quality_score"),
        status.alias("review_status"),
    )


DOCS = """docs AS (SELECT d.doc_id AS idx, split_part(text, chr(10), 1) AS instruction, text AS response, source AS source_type, [lang] AS tags,
  CAST(quality AS DOUBLE) AS quality_score,
  CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' WHEN quality = 0 THEN 'flagged' ELSE 'pending' END AS review_status
  FROM documents d LEFT JOIN labels USING (doc_id))"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, instruction and response of docs, which need no labels: nothing is joined, so no text is shuffled for it."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.substring_index("text", "\n", 1).alias("instruction"), F.col("text").alias("response"))


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, instruction and quality_score of docs. First lines are cut before the labels are joined: whole texts stay where they are."""
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), F.col("quality").cast("double").alias("quality_score"))
    return texts(spark, sf_dir).select("idx", "instruction").join(marks, "idx", "left")


def convs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as idx, instruction, response: the turns of each role joined by blank lines."""
    turns = table(spark, sf_dir, "conversations")
    said = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return to_samples(said.withColumnRenamed("conv_id", "idx"), hub=True).select("idx", "instruction", "response")


CONVS = """convs AS (SELECT * FROM (SELECT conv_id AS idx,
  string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'user') AS instruction,
  string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'assistant') AS response FROM conversations GROUP BY conv_id)
  WHERE instruction IS NOT NULL AND response IS NOT NULL)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as temporal facts: idx, fact, timestamp, group_id, variation_id."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    cents = F.round(F.col("value") * 100).cast("long").cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("idx"),
        F.concat_ws(" ", "event_type", cents, "props").alias("fact"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("group_id"),
        F.row_number().over(order).alias("variation_id"),
    )


FACTS = """facts AS (SELECT event_id AS idx, concat_ws(' ', event_type, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), props) AS fact,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "timestamp", 'user_' || user_id AS group_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS variation_id FROM events)"""
