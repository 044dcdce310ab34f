"""Operator 10: exact dedup as a stateful stream.

A Structured Streaming aggregation keyed by SHA-256 keeps, in RocksDB and without expiry, per digest: the row that
stays (largest identifier), its content locator (file and row) and the number of rows seen. The state lives in the
checkpoint of the shared folder, so a later call with the same folder only reads new files. Every hit, a row whose
digest has been seen on another row, is then held against the full text of the row that stays.

Only DataFrame and SQL functions run on the executors. Copies are counted map-side before the shuffle, so a group
with a third of all rows sends one row per task to the state; joins of rows to groups are plain sort-merge joins
that AQE may split.

Defined cases: a null text counts as empty; a null identifier is smaller than any other; among repeated rows
(same identifier, same text) the one with the largest locator stays, so that exactly one row a group is `first`;
an empty table gives an empty result; other columns are ignored, whatever their names. If two texts share a digest,
their rows are grouped anew by the texts themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: State on disk, and closed after each commit: an open store holds 4 MB of preallocated disk.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: No file is ever too old to be read: by default a stream leaves out files 7 days older than the newest it has taken.
MAX_AGE = "36500d"


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    meta = F.col("_metadata")
    return df.select(
        F.col(id_col).alias("doc_id"),
        text.alias("text"),
        F.sha2(text, 256).alias("digest"),
        meta["file_path"].alias("file"),
        meta["row_index"].alias("at"),
    )


def advance(spark: SparkSession, source: str, state: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Take all files of `source` (Parquet, a folder or one file) that the state at `state` has not seen into it."""
    schema = spark.read.parquet(source).schema
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        # as a pattern, since a stream takes a plain path for a folder, and a table may be a single file
        stream = spark.readStream.schema(schema).option("maxFileAge", MAX_AGE)
        rows = _rows(stream.parquet(f"{source[:-1]}[{source[-1]}]"), id_col, text_col)
        groups = rows.groupBy("digest").agg(
            F.max(F.struct("doc_id", "file", "at")).alias("keep"), F.count(F.lit(1)).alias("group_size")
        )
        run = (
            groups.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def groups(spark: SparkSession, state: str) -> DataFrame:
    """digest, keep struct<doc_id, file, at>, group_size: the keyed state as it stands."""
    held = spark.read.format("statestore").load(state)
    keep, size = held.schema["value"].dataType.names[-2:]
    return held.select(F.col("key.digest").alias("digest"), F.col("value")[keep].alias("keep"), F.col("value")[size].alias("group_size"))


def dedup(spark: SparkSession, source: str, id_col: str = "doc_id", text_col: str = "text", state: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, first, text_sha256, file, at: one row per row of the Parquet at `source`.

    `kept` marks rows with the identifier that stays, `first` exactly one row of each group.
    """
    state = state or common.scratch(spark, "dedup-state")
    plain = spark.read.parquet(source)
    rows = _rows(plain, id_col, text_col)
    if not plain.take(1):
        found = rows.select("*", F.struct("doc_id", "file", "at").alias("keep"), F.lit(1).cast("long").alias("group_size"))
        return _decide(found)
    advance(spark, source, state, id_col, text_col)
    held = common.written(groups(spark, state), common.scratch(spark, "dedup-groups"))
    hits = held.where("group_size > 1").select(F.col("digest"), "keep")
    texts = rows.join(hits, "digest").select(
        "digest", "text", "doc_id", "file", "at", ((F.col("file") == F.col("keep.file")) & (F.col("at") == F.col("keep.at"))).alias("stays")
    )
    texts = common.written(texts, path := common.scratch(spark, "dedup-hits"))
    full = texts.where("stays").select("digest", F.col("text").alias("full"))
    clash = texts.where("not stays").join(full, "digest").where("text != full").select("digest")
    # written before distinct(), which would tie the join to its keys and keep AQE from splitting a hot group
    clash = common.written(clash, common.scratch(spark, "dedup-clash")).distinct()
    # a left join, so that a row the state doesn't know fails below and isn't lost
    lost = F.raise_error("the state has no digest for a row of the source: was a file overwritten?")
    found = rows.drop("text").join(held, "digest", "left")
    found = found.withColumns({"keep": F.coalesce("keep", lost), "group_size": F.coalesce("group_size", lost)})
    if clash.take(1):
        of_texts = texts.join(clash, "digest", "left_semi")
        anew = of_texts.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "at")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        again = of_texts.drop("stays").join(anew, ["digest", "text"]).drop("text")
        found = found.join(clash, "digest", "left_anti").unionByName(again)
    else:
        common.remove(spark, path)
    return _decide(found)


def _decide(found: DataFrame) -> DataFrame:
    keep = F.col("keep")
    return found.select(
        "doc_id",
        keep["doc_id"].alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(keep["doc_id"]).alias("kept"),
        ((F.col("file") == keep["file"]) & (F.col("at") == keep["at"])).alias("first"),
        F.col("digest").alias("text_sha256"),
        "file",
        "at",
    )


def keep_first(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one of each group of equal texts."""
    folder = common.scratch(spark, "dedup-docs")
    docs.write.parquet(folder)
    stays = dedup(spark, folder, id_col, text_col).where("first").select(F.col("file").alias("__file"), F.col("at").alias("__at"))
    rows = spark.read.schema(docs.schema).parquet(folder)
    rows = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("__row"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    return rows.join(stays, ["__file", "__at"], "left_semi").select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
