"""Named data sets in a folder; formats jsonl, json, csv and parquet, all lossless.

A save writes a new folder of data, which nothing changes afterwards, and then one small file, the next number of the set's log,
that says where the data lie and what they are. That file is moved to its name whole and never over another: this move is the
commit. So a save that fails leaves the set as it was, readers keep the snapshot that they began with, and of two
savers that read the same version one is first: the other starts from the new version (`save`) or fails (`update`, or
any save that names the version it expects). Earlier snapshots can be read and restored until `vacuum` removes them.
"""

from __future__ import annotations

import json
import re
import uuid
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.operators import query

FORMATS = ("jsonl", "json", "csv", "parquet")
TRIES = 20


class Conflict(RuntimeError):
    """Another save came first."""


class Store:
    """Each data set is a folder, base/name, with a log and its data; data never pass the driver."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        p = self._path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _log(self, name: str) -> str:
        if not name or name.startswith(("_", ".")) or "/" in name:
            raise ValueError(f"not a name of a data set: {name!r}")
        return f"{self.base}/{name}/_log"

    def versions(self, name: str) -> list[int]:
        return [int(n[:-5]) for n in self._names(self._log(name)) if re.fullmatch(r"\d+\.json", n)]

    def _entries(self, pattern: str) -> dict[str, dict]:
        """The entries of log files by path: one small JSON text each."""
        rows = self.spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("p"), "value").collect()
        return {r.p: json.loads(r.value) for r in rows}

    def _entry(self, name: str, version: int) -> dict:
        (entry,) = self._entries(f"{self._log(name)}/{version:010d}.json").values()
        return entry

    def entry(self, name: str, version: int | None = None) -> dict:
        """What the log says of a set, now or at a version."""
        numbers = self.versions(name)
        if not numbers or (version is not None and version not in numbers):
            raise KeyError(name if version is None else f"{name}, version {version}")
        entry = self._entry(name, numbers[-1] if version is None else version)
        if entry.get("deleted"):
            raise KeyError(name)
        return entry

    def catalog(self) -> dict[str, dict]:
        """The sets there are, by name, each at its last version."""
        latest = [f"{self._log(n)}/{v[-1]:010d}.json" for n in self._names(self.base) if not n.startswith(("_", ".")) and (v := self.versions(n))]
        found = self._entries(latest).values() if latest else []
        return {e["name"]: e for e in sorted(found, key=lambda e: e["name"]) if not e.get("deleted")}

    def history(self, name: str) -> list[dict]:
        """All entries of a set, the first version first."""
        return sorted(self._entries(f"{self._log(name)}/*.json").values(), key=lambda e: e["version"]) if self.versions(name) else []

    def _commit(self, name: str, version: int, entry: dict) -> dict:
        """The entry as that version; `Conflict` if the version is there."""
        entry = entry | {"name": name, "version": version}
        self._write(aside := f"{self.base}/{name}/_tmp-{uuid.uuid4().hex}", json.dumps(entry))
        fs, source = self._fs(aside)
        fs.mkdirs(self._path(self._log(name)))
        target = self._path(f"{self._log(name)}/{version:010d}.json")
        jvm = self.spark.sparkContext._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        never_over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(source, target, never_over)
        except Py4JJavaError as e:
            fs.delete(source, False)
            if "FileAlreadyExists" in e.java_exception.toString():
                raise Conflict(f"{name}: version {version} is there") from None
            raise
        return entry

    def _write(self, path: str, text: str) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, False)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def save(self, samples: DataFrame, name: str, format: str = "jsonl", metadata: dict | None = None, expected: int | None = None) -> dict:
        """A new version with these samples. `expected`: the version that it follows (0: none); another is a `Conflict`."""
        if format not in FORMATS:
            raise ValueError(f"unsupported format {format!r}")
        path = f"{self.base}/{name}/data-{uuid.uuid4().hex}.{format}"
        self._log(name)  # a name of a set
        if format == "parquet":
            samples.write.parquet(path)
        elif format == "csv":
            flat = samples.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name) for f in samples.schema.fields])
            flat.write.csv(path, header=True, escape='"', emptyValue='""', nullValue="\\N")
        else:
            samples.write.option("ignoreNullFields", "false").json(path)
        kept = self.read(path, format, samples.schema)
        about = {"path": path, "format": format, "schema": samples.schema.json(), "sample_count": kept.count(), "statistics": self.statistics(kept)}
        for _ in range(TRIES):
            last = (self.versions(name) or [0])[-1]
            if expected is not None and last != expected:
                break
            before = self._entry(name, last) if last else {}
            before = {} if before.get("deleted") else before
            now = datetime.now(UTC).isoformat()
            told = {"created_at": before.get("created_at", now), "updated_at": now, "custom_metadata": metadata if metadata is not None else before.get("custom_metadata", {})}
            try:
                return self._commit(name, last + 1, about | told)
            except Conflict:
                if expected is not None:
                    break
        fs, p = self._fs(path)
        fs.delete(p, True)
        raise Conflict(f"{name} was saved by another since version {expected}")

    @staticmethod
    def statistics(samples: DataFrame) -> dict:
        """Counts by source type, tag and review status, and the quality scores' mean, std, min and max, where there are any."""
        names = {"source": "source_types", "tag": "tags", "status": "review_statuses"}
        needed = {"source_type": "string", "tags": "array<string>", "review_status": "string", "quality_score": "double"}
        df = samples.select(*[(F.col(c).cast(t) if c in samples.columns else F.lit(None).cast(t)).alias(c) for c, t in needed.items()])
        out: dict = {n: {} for n in names.values()}
        for r in query.distributions(df).where("kind != 'quality'").orderBy("kind", "value").collect():
            out[names[r.kind]][r.value] = r.n
        q = query.store_metadata(df).first()
        if q.n_scored:
            out["quality_statistics"] = {k: q[k] for k in ("mean", "std", "min", "max")}
        return out if q.n else {}

    def read(self, path: str, format: str, schema: T.StructType) -> DataFrame:
        if format == "parquet":
            return self.spark.read.parquet(path)
        if format == "csv":
            nested = {f.name: f.dataType for f in schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))}
            flat = T.StructType([T.StructField(f.name, T.StringType() if f.name in nested else f.dataType) for f in schema.fields])
            df = self.spark.read.csv(path, header=True, schema=flat, multiLine=True, escape='"', emptyValue="", nullValue="\\N")
            return df.select(*[F.from_json(c, nested[c]).alias(c) if c in nested else F.col(c) for c in df.columns])
        return self.spark.read.schema(schema).json(path)

    def load(self, name: str, version: int | None = None) -> DataFrame:
        entry = self.entry(name, version)
        return self.read(entry["path"], entry["format"], T.StructType.fromJson(json.loads(entry["schema"])))

    def update(self, samples: DataFrame, name: str, expected: int | None = None) -> dict:
        """Same format and custom metadata; the time of creation stays. Samples may come from the set itself, as its snapshot
        isn't changed; a version that another has saved since this call (or since `expected`) is a `Conflict`."""
        entry = self.entry(name)
        return self.save(samples, name, entry["format"], expected=entry["version"] if expected is None else expected)

    def restore(self, name: str, version: int) -> dict:
        """An earlier snapshot as the newest version, without a copy."""
        return self._commit(name, self.versions(name)[-1] + 1, self.entry(name, version) | {"updated_at": datetime.now(UTC).isoformat(), "restored": version})

    def undo(self, name: str) -> dict:
        """The snapshot before the last change; undone changes and those of `restore` are followed to what they brought back."""
        of = {e["version"]: e for e in self.history(name)}
        at = max(of)
        while "restored" in of[at]:
            at = of[at]["restored"]
        earlier = [v for v, e in of.items() if v < at and not e.get("deleted") and "restored" not in e]
        if not earlier:
            raise KeyError(f"{name} has no earlier version")
        return self.restore(name, max(earlier))

    def delete(self, name: str) -> None:
        """The set is gone with a last entry that says so; then its data go."""
        entry = self.entry(name)
        self._commit(name, entry["version"] + 1, {"deleted": True})
        self.vacuum(name)

    def vacuum(self, name: str, keep: int = 1) -> int:
        """Removes data that none of the last `keep` entries holds; how many folders. Saves under way must not be interrupted by it."""
        held = {e.get("path", "").rsplit("/", 1)[-1] for e in self.history(name)[-keep:]}
        gone = [n for n in self._names(f"{self.base}/{name}") if n.startswith("data-") and n not in held]
        for n in gone:
            fs, p = self._fs(f"{self.base}/{name}/{n}")
            fs.delete(p, True)
        return len(gone)
