"""Tables in the folder that driver and executors share, used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local folder in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_made: list[list[str]] = []


@contextmanager
def removed_after(spark: SparkSession) -> Iterator[None]:
    """Removes, at the end, the scratch folders named within: for steps whose result is written before it."""
    _made.append(mine := [])
    try:
        yield
    finally:
        _made.remove(mine)
        for path in mine:
            remove(spark, path)


def scratch(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/quillmill/{tag}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def written(df: DataFrame, path: str) -> DataFrame:
    """Write to the shared folder and read back: the files outlive any executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
