"""The corpus pipeline: five stages, each an operator of quillmill.llm on all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's
docs. All but the last return the columns of documents. Defined cases: rows with null columns pass each stage by the rules
of its operator (null text counts as empty; a row without an id is never a near duplicate); an empty table gives no
sequences. SQL can't express the classifiers or the tokenizer, so there is no ORACLE_SQL.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import common, exact_dedup, near_dup, packing, quality, toxicity

#: Near duplicates of the pipeline share this percentage of their 5-word shingles.
PERCENT = 80


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the co-trained classifier holds for poor text."""
    return quality.keep_good(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects toxic documents; the machine learns from the folds that the toxicity query may learn from."""
    return toxicity.keep_clean(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels"), toxicity.fold(F.col("id")) != 0))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return exact_dedup.keep_first(spark, docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return near_dup.keep_one(docs, percent=PERCENT)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality", good), ("toxicity", clean), ("exact_dedup", distinct), ("near_dedup", unlike), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = common.scratch(spark, f"pipeline-{name}")
        with common.removed_after(spark):  # what a stage wrote on its way
            docs = common.written(stage(spark, docs, sf_dir), folder)
        if before:
            common.remove(spark, before)
        before = folder
    return docs
