"""Generation jobs that go on where they were stopped.

The prompts of a job are written once, in files of a batch's size. A stream takes them file by file; each batch is answered in
`foreachBatch` and written, answers and errors apart, to folders named by the batch, which a second try overwrites or finds
whole: so a batch counts once, and a run after a kill, on the same folder, calls the model only for batches that were
not finished. Tasks keep a bounded number of calls in flight, and each call is tried again after a growing pause. Progress is a
row a batch.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators.generate import TextGenerator
from quillmill.plans.scratch import remove

ANSWERS = "id string, prompt string, answer string, tries int"
ERRORS = "id string, prompt string, error string, tries int"


def answered(prompts: DataFrame, make: Callable[[], TextGenerator], in_flight: int = 4, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """id, prompt, answer, error, tries: of prompts (id, prompt). At most `in_flight` calls of a task run at once.

    The answer is null after `tries` calls without text; the error says what the last one was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()

        def ask(prompt: str | None) -> tuple[str | None, str | None, int]:
            if prompt is None:
                return None, "no prompt", 0
            said = "no answer"
            for k in range(1, tries + 1):
                try:
                    if found := model.generate(prompt):
                        return found, None, k
                    said = "no answer"
                except Exception as e:  # noqa: BLE001 - whatever a model raises is that row's error
                    said = f"{type(e).__name__}: {e}"
                if k < tries:
                    time.sleep(pause * 2 ** (k - 1))
            return None, said, tries

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["id", "prompt", "answer", "error", "tries"])

        with ThreadPoolExecutor(in_flight) as pool:
            for b in batches:
                waiting: deque[tuple[str, str, Future]] = deque()
                done = []
                for i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if len(waiting) == in_flight:
                        x, y, f = waiting.popleft()
                        done.append((x, y, *f.result()))
                    waiting.append((i, p, pool.submit(ask, p)))
                done += [(x, y, *f.result()) for x, y, f in waiting]
                yield batch(done)

    rows = prompts.select(F.col("id").cast("string").alias("id"), F.col("prompt").cast("string").alias("prompt"))
    return rows.mapInArrow(run, "id string, prompt string, answer string, error string, tries int")


class GenerationJob:
    """A job in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, make: Callable[[], TextGenerator], in_flight: int = 4, tries: int = 3, pause: float = 1.0):
        self.spark, self.folder, self.make = spark, folder.rstrip("/"), make
        self.how = {"in_flight": in_flight, "tries": tries, "pause": pause}

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def submit(self, prompts: DataFrame, per_batch: int = 10_000) -> None:
        """The job's prompts (id, prompt), written once: a job that has them keeps them. A file is a batch."""
        if not self._exists("prompts/_SUCCESS"):
            rows = prompts.select(F.col("id").cast("string").alias("id"), F.col("prompt").cast("string").alias("prompt"))
            rows.write.mode("overwrite").option("maxRecordsPerFile", per_batch).parquet(f"{self.folder}/prompts")

    def _batch(self, df: DataFrame, number: int) -> None:
        if self._exists(f"progress/batch={number}/_SUCCESS"):
            return  # finished, though the stream didn't hear of it
        began, place = time.time(), f"batch={number}"
        answered(df.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism)), self.make, **self.how).write.mode("overwrite").parquet(f"{self.folder}/raw/{place}")
        raw = df.sparkSession.read.schema(f"{ANSWERS}, error string").parquet(f"{self.folder}/raw/{place}")
        raw.where("answer is not null").select("id", "prompt", "answer", "tries").write.mode("overwrite").parquet(f"{self.folder}/answers/{place}")
        raw.where("answer is null").select("id", "prompt", "error", "tries").write.mode("overwrite").parquet(f"{self.folder}/errors/{place}")
        told = raw.agg(F.count(F.lit(1)).alias("n"), F.count("answer").alias("answered"), F.coalesce(F.sum("tries"), F.lit(0)).alias("calls"))
        told.withColumn("seconds", F.lit(time.time() - began)).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/progress/{place}")
        remove(self.spark, f"{self.folder}/raw/{place}")

    def run(self) -> DataFrame:
        """Answers all prompts that no earlier run has; the job's progress."""
        rows = self.spark.readStream.schema("id string, prompt string").option("maxFilesPerTrigger", 1).option("maxFileAge", "36500d").parquet(f"{self.folder}/prompts")
        stream = rows.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        stream.awaitTermination()
        return self.progress()

    def _read(self, what: str, schema: str) -> DataFrame:
        if not self._exists(what):
            return self.spark.createDataFrame([], f"{schema}, batch int")
        return self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.folder}/{what}")

    def answers(self) -> DataFrame:
        """id, prompt, answer, tries, batch."""
        return self._read("answers", ANSWERS)

    def errors(self) -> DataFrame:
        """id, prompt, error, tries, batch: prompts left without an answer."""
        return self._read("errors", ERRORS)

    def progress(self) -> DataFrame:
        """batch, n, answered, calls, seconds."""
        return self._read("progress", "n long, answered long, calls long, seconds double")

    def retry(self, folder: str, per_batch: int = 10_000) -> GenerationJob:
        """A job of the prompts left without an answer, with other settings if need be."""
        job = GenerationJob(self.spark, folder, self.make, **self.how)
        job.submit(self.errors().where("prompt is not null"), per_batch)
        return job
