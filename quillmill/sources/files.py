"""Readers of JSON, JSONL, CSV, Parquet and marked text as samples, with file and line."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions.text import strip
from quillmill.plans.scratch import scratch, written
from quillmill.sources import csv_records
from quillmill.sources.records import hub_samples, quoted, to_samples

log = logging.getLogger("quillmill.sources")
#: Names under which a JSON file keeps its list, the first of them that occurs.
LISTS = ("data", "samples", "examples")
#: Marks of samples in text files.
MARKS = ("=== INSTRUCTION ===", "=== RESPONSE ===", "=== END ===")
#: Tasks that list the folders of a read; by default each folder would be a task of its own.
LISTING, TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 64
SUFFIXES = {".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".csv": "csv", ".parquet": "parquet", ".txt": "txt"}


@contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """What is read within lists its folders by few tasks, as files are listed when a table is opened."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(TASKS))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


def json_items(value: Column) -> Column:
    """The records in a file's text, as JSON texts: of a list, of the list under data, samples or examples, or the one
    record. Null if the text is none of these."""
    head, keys = F.regexp_extract(value, r"\A\s*(.)", 1), F.json_object_keys(value)
    inner = F.coalesce(*[F.when(F.array_contains(keys, k), F.struct(F.get_json_object(value, f"$.{k}").alias("list"))) for k in LISTS])
    listed = F.when(inner.isNull(), F.array(value)).otherwise(F.from_json(inner["list"], "array<string>"))
    return F.when(head == "[", F.from_json(value, "array<string>")).when((head == "{") & keys.isNotNull(), listed)


def json_rejects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source_file, reason: of the files that hold no JSON records."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), json_items(F.col("value")).alias("items"))
    return whole.where("items is null").select("source_file", F.lit("holds no JSON records").alias("reason"))


def read_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of JSON files, each file by its own shape (see `json_items`), numbered from 1.

    Files are read whole, so a file goes to one task. A file that isn't JSON of such a shape is left out with a warning, an
    item that isn't an object is left out but counted."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), json_items(F.col("value")).alias("items"))
    rows = whole.select("source_file", F.posexplode("items").alias("at", "line")).where(F.startswith("line", F.lit("{")))
    kind = F.schema_of_variant_agg(F.try_parse_json("line"))
    bad = whole.where("items is null").agg(F.count(F.lit(1)), F.min("source_file")).first()
    if bad[0]:
        log.warning("%d files hold no JSON records, such as %s", bad[0], bad[1])
    found = rows.agg(kind).first()[0]
    if not found.startswith("OBJECT<"):
        return rows.select("source_file", (F.col("at") + 1).alias("source_line")).limit(0)
    schema = re.sub(r"(: |ARRAY<)(VOID|VARIANT)(?=[,>])", r"\1STRING", found).replace("OBJECT<", "STRUCT<")
    out = rows.select(F.from_json("line", schema).alias("r"), "source_file", (F.col("at") + 1).alias("source_line")).where("r is not null")
    return out.select("r.*", "source_file", "source_line")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source_file, source_line, line: text files by line, with physical line numbers from 1.

    Files are read in splits, as large ones must be. A split's lines have consecutive row ids, so a line's number is its
    distance from its split's first id, and the number of lines in earlier splits of the file: one row a split."""
    with listing(spark):
        lines = spark.read.text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("__at"))
    lines = lines.withColumn("__id", F.monotonically_increasing_id())
    splits = lines.groupBy("source_file", "__at").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source_file").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("__before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    number = (F.col("__before") + F.col("__id") - F.col("__first") + 1).cast("int")
    return lines.join(F.broadcast(splits), ["source_file", "__at"]).select("source_file", number.alias("source_line"), F.col("value").alias("line"))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """One record a line, with its physical line number; blank and malformed lines are skipped."""
    lines = numbered_lines(spark, path).where(strip(F.col("line")) != "")
    if schema is None:
        with listing(spark):
            schema = spark.read.json(path).drop("_corrupt_record").schema
    rows = lines.withColumn("r", F.from_json("line", schema, {"mode": "PERMISSIVE"})).where(F.try_parse_json("line").isNotNull() & F.col("r").isNotNull())
    return rows.select("r.*", "source_file", "source_line")


def read_prompts(spark: SparkSession, path: str, keys: tuple[str, ...] = ("instruction", "prompt", "problem", "question", "text")) -> DataFrame:
    """instruction: seeds, prompts or problems from JSON (a list of texts or records), JSONL or plain lines."""
    if path.endswith((".jsonl", ".ndjson")):
        lines = numbered_lines(spark, path)
    elif path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), "value")
        lines = whole.select("source_file", F.posexplode(F.variant_get(F.try_parse_json("value"), "$", "array<variant>")).alias("source_line", "v"))
        lines = lines.select("source_file", "source_line", F.to_json("v").alias("line"))
    else:
        lines = numbered_lines(spark, path).select("source_file", "source_line", F.to_json(F.struct(F.col("line").alias(keys[0]))).alias("line"))
    v = F.try_parse_json("line")
    text = F.coalesce(*[F.nullif(strip(F.try_variant_get(v, f"$.{k}", "string")), F.lit("")) for k in keys])
    bare = F.when(F.schema_of_variant(v) == "STRING", F.nullif(strip(F.try_variant_get(v, "$", "string")), F.lit("")))
    return lines.select(F.coalesce(bare, text).alias("instruction"), "source_file", "source_line").where("instruction is not null")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """text, source_file: one file, or the .txt and .md files of a folder, whole."""
    names = None if path.endswith((".txt", ".md")) else "*.{txt,md}"
    return spark.read.text(path, wholetext=True, pathGlobFilter=names).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source_file"))


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Each file by its own header, cells as text, missing cells null. Line numbers count the header, so the first record is on
    line 2. A file in which a record has more cells than the header is left out."""
    return _csv_rows(*_csv(spark, [path] if isinstance(path, str) else path))


def _csv_rows(rows: DataFrame, headers: DataFrame) -> DataFrame:
    headers = headers.where("not long").select("source_file", "names")
    found = [r[0] for r in headers.select(F.explode("names").alias("name")).distinct().orderBy("name").collect()]  # the schema
    rows = rows.where("record > 1").join(headers, "source_file")
    pairs = F.map_from_arrays("names", F.transform(F.sequence(F.lit(1), F.size("names")), lambda k: F.try_element_at("cells", k)))
    rows = rows.select(pairs.alias("r"), "source_file", F.col("record").cast("int").alias("source_line"))
    return rows.select(*[F.element_at("r", n).alias(n) for n in found if n not in ("source_file", "source_line")], "source_file", "source_line")


def _csv(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records, and source_file, names, long (a record has more cells than the header): one row a file."""
    rows = written(csv_records.records(spark, paths), scratch(spark, "csv-records"))
    first = F.first(F.when(F.col("record") == 1, F.col("cells")), True)
    headers = rows.groupBy("source_file").agg(first.alias("header"), F.max(F.when(F.col("record") > 1, F.size("cells"))).alias("most"))
    headers = headers.select("source_file", csv_records.names(F.col("header")).alias("names"), F.coalesce(F.col("most") > F.size("header"), F.lit(False)).alias("long"))
    return rows, headers


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The schema is merged over all files, since Spark takes any one file's otherwise, corrupt or not."""
    paths = [path] if isinstance(path, str) else path
    return spark.read.options(ignoreCorruptFiles="true", mergeSchema="true").parquet(*paths).select("*", F.col("_metadata.file_path").alias("source_file"), (F.col("_metadata.row_index") + 1).alias("source_line"))


def parquet_groups(spark: SparkSession, paths: list[str]) -> tuple[list[list[str]], list[tuple[str, str]]]:
    """Groups of files whose schemas merge, and the files without a readable footer, with the reason.

    Footers are merged by a Spark job over all files; where that fails, both halves are tried, so a few odd files cost a few
    jobs. Groups of one schema are put together again."""
    groups: dict[str, list[str]] = {}
    bad: list[tuple[str, str]] = []
    todo = [paths] if paths else []
    while todo:
        these = todo.pop()
        try:
            schema = spark.read.options(mergeSchema="true", ignoreCorruptFiles="false").parquet(*map(literal, these)).schema
            groups.setdefault(schema.json(), []).extend(these)
        except (PySparkException, Py4JJavaError) as e:
            if len(these) == 1:
                bad.append((these[0], str(e).splitlines()[0][:200]))
            else:
                todo += [these[: len(these) // 2], these[len(these) // 2 :]]
    return list(groups.values()), sorted(bad)


def read_marked_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Blocks of marked text files, without line numbers.

    A file with both of the marks below is cut at the end marks, and a block needs exactly one response mark; another file may
    have INSTRUCTION:, RESPONSE: and END lines instead. Other text holds no samples."""
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_file"))
    said, answer, end = MARKS
    marked = F.contains("value", F.lit(said)) & F.contains("value", F.lit(answer))
    parts = F.split("block", re.escape(answer), -1)
    one = whole.where(marked).select("source_file", F.explode(F.split("value", re.escape(end), -1)).alias("block")).where(F.size(parts) == 2)
    one = one.select(strip(F.replace(parts[0], F.lit(said), F.lit(""))).alias("instruction"), strip(parts[1]).alias("response"), "source_file", F.lit(None).cast("int").alias("source_line"))
    blocks = whole.where(~marked).select("source_file", F.posexplode(F.split("value", r"(?m)^INSTRUCTION:")).alias("at", "block")).where("at > 0")
    parts = F.split(F.regexp_replace("block", r"(?ms)^END\s*$.*", ""), r"(?m)^RESPONSE:")
    return one.unionByName(
        blocks.where(F.size(parts) == 2).select(strip(parts[0]).alias("instruction"), strip(parts[1]).alias("response"), "source_file", F.col("at").alias("source_line"))
    )


READERS = {"json": read_json, "jsonl": read_jsonl, "csv": read_csv, "parquet": read_parquet, "txt": read_marked_text}


def literal(path: str) -> str:
    """A path for readers that would take some characters of a name for a pattern."""
    return re.sub(r"([\\{}\[\]*?,])", r"\\\1", path)


def expand(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files and folders of paths and patterns. A path without one raises, a pattern without one warns; nothing at all
    raises."""
    if not paths:
        raise ValueError("no path given")
    found, conf = [], spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(conf)
        if not re.search(r"[*?]", p):
            if not fs.exists(at):
                raise FileNotFoundError(f"no file {p}")
            found.append(p)
            continue
        hits = fs.globStatus(at) or []
        if not len(hits):
            log.warning("no file matches %s", p)
        found += sorted(h.getPath().toString() for h in hits)
    if not found:
        raise ValueError("no files found")
    return found


def _listed(spark: SparkSession, path: str) -> list[str]:
    """A file, or the files in a folder that a job wrote."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.getFileStatus(at).isDirectory():
        return [path]
    out, files = [], fs.listFiles(at, True)
    while files.hasNext():
        p = files.next().getPath()
        if not p.getName().startswith(("_", ".")):
            out.append(p.toString())
    return sorted(out)


def union(frames: list[DataFrame]) -> DataFrame:
    """All rows by column name; a column of several types becomes text."""
    types: dict[str, set[str]] = {}
    for df in frames:
        for f in df.schema.fields:
            types.setdefault(f.name, set()).add(f.dataType.simpleString())
    mixed = {n for n, t in types.items() if len(t) > 1}

    def text(df: DataFrame) -> DataFrame:
        nested = (T.ArrayType, T.StructType, T.MapType, T.VariantType)
        of = {f.name: F.col(quoted(f.name)) for f in df.schema.fields}
        as_text = {f.name: F.to_json(of[f.name]) if isinstance(f.dataType, nested) else of[f.name].cast("string") for f in df.schema.fields if f.name in mixed}
        return df.select(*[as_text.get(n, c).alias(n) for n, c in of.items()])

    out = text(frames[0])
    for df in frames[1:]:
        out = out.unionByName(text(df), allowMissingColumns=True)
    return out


def scan(spark: SparkSession, paths: str | list[str], **fields) -> tuple[DataFrame, DataFrame]:
    """Samples of all files, each read by its own suffix (in any case) and its own header or footer; and the rejects: source_file,
    reason, of the files that have no reader or can't be read. A folder with such a suffix is a set of files."""
    by_kind: dict[str, list[str]] = {}
    bad: list[tuple[str, str]] = []
    for p in expand(spark, [paths] if isinstance(paths, str) else list(paths)):
        kind = next((k for s, k in SUFFIXES.items() if p.rstrip("/").lower().endswith(s)), None)
        if kind is None:
            bad.append((p, "no reader for this suffix"))
        else:
            by_kind.setdefault(kind, []).extend(_listed(spark, p))
    frames, rejects = [], []
    for kind, found in sorted(by_kind.items()):
        if kind == "parquet":
            groups, odd = parquet_groups(spark, found)
            bad += odd
        else:
            groups = [found] if found else []
        for group in groups:
            names = [literal(p) for p in group]
            if kind == "csv":
                rows, headers = _csv(spark, names)
                frames.append(to_samples(_csv_rows(rows, headers), **fields))
                rejects.append(headers.where("long").select("source_file", F.lit("a record has more cells than the header").alias("reason")))
                continue
            frames.append(to_samples(READERS[kind](spark, names), **fields))
            if kind == "json":
                rejects.append(json_rejects(spark, names))
    for p, reason in bad:
        log.warning("%s is left out: %s", p, reason)
    rejects.insert(0, spark.createDataFrame(bad, "source_file string, reason string"))
    if not frames:
        frames = [spark.createDataFrame([], "source_file string, source_line int, instruction string, response string")]
    return union(frames).withColumn("source_type", F.lit("fileloader")), union(rejects)


def load(spark: SparkSession, paths: str | list[str], **fields) -> DataFrame:
    """The samples of `scan`; what is left out is told by a warning."""
    return scan(spark, paths, **fields)[0]


def load_hub(spark: SparkSession, base: str, name: str, split: str = "train", subset: str | None = None, **fields) -> DataFrame:
    """Samples of a hub data set's export, base/name[/subset]/split*.parquet or .jsonl, numbered over its files from 0."""
    if not name:
        raise ValueError("a data set needs a name")
    stem = "/".join([base.rstrip("/"), name, *([subset] if subset else []), split])
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{stem}*.parquet")
    parquet = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    rows = read_parquet(spark, f"{stem}*.parquet") if parquet else read_jsonl(spark, f"{stem}*.jsonl")
    earlier = Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    before = rows.groupBy("source_file").agg(F.max("source_line").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    rows = rows.join(F.broadcast(before.drop("n")), "source_file").withColumn("idx", F.col("before") + F.col("source_line") - 1).drop("before")
    return hub_samples(rows, name, **fields)


def count(spark: SparkSession, paths: str | list[str], **fields) -> int | None:
    """Samples of files; None where they can't be read."""
    try:
        return load(spark, paths, **fields).count()
    except (OSError, ValueError, PySparkException):
        return None


def count_hub(spark: SparkSession, base: str, name: str, split: str = "train", subset: str | None = None, streaming: bool = False) -> int | None:
    """Rows of a hub data set's export, from the footers of its Parquet files or the lines of the others; None for a stream
    and where it can't be read."""
    stem = "/".join([base.rstrip("/"), name, *([subset] if subset else []), split])
    if streaming:
        return None
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{stem}*.parquet")
    try:
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at):
            return spark.read.parquet(f"{stem}*.parquet").count()  # reads no column
        return spark.read.text(f"{stem}*.jsonl").where(strip(F.col("value")) != "").count()
    except PySparkException:
        return None


def register(kind: str, suffixes: tuple[str, ...], reader: Callable[..., DataFrame]) -> None:
    """A further reader: `scan` gives it the session and the list of its files, and takes rows with source_file from it."""
    READERS[kind] = reader
    SUFFIXES.update(dict.fromkeys((x.lower() for x in suffixes), kind))


def write_records(df: DataFrame, path: str, format: str = "jsonl") -> None:
    """Points of series, facts or other records as jsonl, json (each file one list) or csv (with a header)."""
    if format == "jsonl":
        df.write.option("ignoreNullFields", "false").json(path)
    elif format == "csv":
        df.write.csv(path, header=True, escape='"')
    elif format == "json":
        lines = df.select(F.to_json(F.struct(*[quoted(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))

        def listed(batches):
            first = True
            for b in batches:
                if b.num_rows:
                    texts = b.column(0).to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([("[" if first and k == 0 else ",") + t for k, t in enumerate(texts)], pa.string())], names=["value"])
                    first = False
            yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"], pa.string())], names=["value"])

        lines.mapInArrow(listed, "value string").write.text(path)
    else:
        raise ValueError(f"unsupported format {format!r}")
