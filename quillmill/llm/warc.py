"""Operator 5: deterministic sharded WARC writer and its reader.

Records are sorted by id, those of one id by a hash of the payload. Cuts of this order, which depend on the input alone,
make shards of about `SHARD_BYTES` of payload (more where over 50,000 of them would be needed); a task walks one shard in
order and rolls to a new file when the compressed size passes `ROLL_BYTES`. Each
record is a gzip member of its own, with headers and digests computed anew from the payload. Files are written under
temporary names, renamed when complete and listed, with sizes and checksums, in the manifest, a Parquet table that
Spark commits last. Readers only open files of the manifest, so what a lost executor or a second attempt leaves behind
is never read; an attempt that comes again writes the same bytes and replaces the file of that name.

Equal payloads of `REVISIT_BYTES` or more are stored once: the record with the largest id is the response, the others
are revisits that name it. Payloads are compared by SHA-256 and length. The groups are pre-aggregated from thin rows
and written, so that AQE may split the join of the thin rows with them where a payload has many copies; payloads
themselves are shuffled once, into their shards.

Defined cases: a null payload is empty; a null id is smaller than any other and written without an id header; records
alike in id and payload are written each, the response is one with the largest id and, if several rows share it, all
of them are responses; a null URL gives an empty target; an empty table gives an empty manifest and no records; other
columns are ignored. Payloads are held one at a time.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARD_BYTES = 32 << 20
ROLL_BYTES = 16 << 20
REVISIT_BYTES = 1000
#: A date that doesn't depend on the clock, and the profile of revisits by equal digest.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, shard int, number int, records long, bytes long, sha256 string"
RECORD = "record_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record_id(id_, kind: str, sha1: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{id_}:{kind}:{sha1.hex()}')}>"


def record_bytes(id_, url: str | None, kind: str, refers_to, payload: bytes, sha1: bytes) -> bytes:
    """One WARC/1.1 record, compressed; the same input gives the same bytes. A revisit's block is the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(id_, kind, sha1)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{b32encode(sha1).decode()}",
        f"WARC-Block-Digest: sha1:{b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if id_ is not None:
        head.append(f"X-Row-ID: {id_}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, 'response', sha1)}", f"X-Refers-To-Row: {refers_to}"]
    out = io.BytesIO()
    with gzip.GzipFile(filename="", mode="wb", fileobj=out, mtime=0) as z:
        z.write("\r\n".join(head).encode("utf-8") + b"\r\n\r\n")
        z.write(block)
        z.write(b"\r\n\r\n")
    return out.getvalue()


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class _Roller:
    """Writes the files of one shard: temporary name first, final name when the file is complete."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.fs, self.root = _filesystem(folder)
        self.shard, self.roll, self.number, self.out = shard, roll, 0, None

    def add(self, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.root}/.{self.name}.{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.records, self.bytes, self.sum = 0, 0, hashlib.sha256()
        self.out.write(data)
        self.records, self.bytes = self.records + 1, self.bytes + len(data)
        self.sum.update(data)
        if self.bytes >= self.roll:
            yield self.close()

    def _holds(self, path: str) -> bool:
        """Whether the file is there and has the size and the checksum of what was written."""
        info = self.fs.get_file_info(path)
        if info.type != pafs.FileType.File or info.size != self.bytes:
            return False
        seen = hashlib.sha256()
        with self.fs.open_input_stream(path, compression=None) as f:
            while data := f.read(1 << 20):
                seen.update(data)
        return seen.digest() == self.sum.digest()

    def _move(self, final: str) -> None:
        """To the final name, over a torn file of that name if there is one."""
        try:
            self.fs.move(self.temporary, final)
        except OSError:  # where a move never goes over a file
            if self._holds(final):  # another attempt came first
                self.fs.delete_file(self.temporary)
                return
            self.fs.delete_file(final)
            self.fs.move(self.temporary, final)

    def close(self) -> tuple:
        self.out.close()
        final = f"{self.root}/{self.name}"
        if self._holds(final):  # of an earlier attempt, which wrote the same bytes: a committed file is never taken away
            self.fs.delete_file(self.temporary)
        else:
            self._move(final)
        row = (self.name, self.shard, self.number, self.records, self.bytes, self.sum.hexdigest())
        self.out, self.number = None, self.number + 1
        return row


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", roll: int = ROLL_BYTES) -> DataFrame:
    """Write the archives to `folder` (a URI that every machine reaches) and return the committed manifest."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("tie", F.xxhash64("payload"))
    size = F.octet_length("payload")
    thin = rows.select("id", "tie", size.alias("size"), F.sha2("payload", 256).alias("same")).where(size >= REVISIT_BYTES)
    largest = thin.groupBy("same", "size").agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    # written, since an aggregate ties a join to its keys and keeps AQE from splitting a payload with many copies
    largest = common.written(largest, common.scratch(spark, "warc-copies"))
    cuts = common.ranges(rows, F.col("id"), F.col("tie"), size + 512, SHARD_BYTES)
    # revisits travel as markers that sort before their records, so payloads are shuffled once
    is_revisit = ~F.col("id").eqNullSafe(F.col("largest"))
    markers = thin.join(largest, ["same", "size"]).where(is_revisit)
    markers = markers.select("id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "tie", "same", F.col("largest").alias("refers_to"))
    rows = rows.select("id", "url", "payload", "tie", F.lit(None).cast("string").alias("same"), F.lit(None).cast("long").alias("refers_to"))
    rows = rows.unionByName(markers).withColumn("shard", cuts.of(F.col("id"), F.col("tie")))
    rows = rows.repartitionById(cuts.count, "shard").sortWithinPartitions("id", "tie", F.asc_nulls_last("same"), "url", "payload")

    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)

    def run(batches):
        roller, of, refers = None, object(), {}
        for b in batches:
            done = []
            for id_, url, body, tie, same, target, shard in _rows(b):
                if of != (id_, tie):
                    of, refers = (id_, tie), {}
                if same is not None:
                    refers[same] = target
                    continue
                roller = roller or _Roller(folder, shard, roll)
                to = refers.get(hashlib.sha256(body).hexdigest()) if refers else None
                done += roller.add(record_bytes(id_, url, "response" if to is None else "revisit", to, body, hashlib.sha1(body).digest()))
            yield _batch(done)
        if roller is not None and roller.out is not None:
            yield _batch([roller.close()])

    manifest = rows.mapInArrow(run, MANIFEST)
    return common.written(manifest, f"{folder}/_manifest")


def _rows(b: pa.RecordBatch, at_once: int = 64) -> Iterator[tuple]:
    for at in range(0, b.num_rows, at_once):
        yield from zip(*(c.to_pylist() for c in b.slice(at, at_once).columns), strict=True)


def _batch(done: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate(kinds)], names=["path", "shard", "number", "records", "bytes", "sha256"])


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, read a gzip member at a time."""
    held, member, out = b"", zlib.decompressobj(31), []
    while True:
        if not held:
            held = stream.read(1 << 20)
            if not held:
                break
        out.append(member.decompress(held))
        held = b""
        if member.eof:
            held, data = member.unused_data, b"".join(out)
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8").split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])]
            member, out = zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("the archive ends within a record")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the archives that the manifest of `folder` lists; each is checked against its digests."""

    def label(data: bytes) -> str:
        return "sha1:" + b32encode(hashlib.sha1(data).digest()).decode()

    def run(batches):
        fs, root = _filesystem(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{path}", compression=None) as f:
                    rows, held = [], 0
                    for h, block in records(f):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        revisit = h["WARC-Type"] == "revisit"
                        if label(block) != h["WARC-Block-Digest"] or (not revisit and label(payload) != h["WARC-Payload-Digest"]):
                            raise ValueError(f"a record of {path} doesn't match its digests")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        digest = b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        row_id = int(h["X-Row-ID"]) if "X-Row-ID" in h else None
                        refers = int(h["X-Refers-To-Row"]) if revisit else None
                        rows.append((row_id, h["WARC-Target-URI"], h["WARC-Type"], refers, size, digest, payload))
                        held += len(block)
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield _records(rows)
                            rows, held = [], 0
                    yield _records(rows)

    files = spark.read.parquet(f"{folder}/_manifest").select("path")
    return files.repartition(max(1, min(files.count(), 100_000))).mapInArrow(run, RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["record_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch(spark, "warc")
    write(common.table(spark, sf_dir, "pages"), folder)
    back = read(spark, folder)
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
SELECT page_id, n AS payload_bytes, payload_digest, CASE WHEN n < 1000 OR page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n < 1000 OR page_id = largest THEN NULL ELSE largest END AS refers_to
FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS payload_digest,
             max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest FROM pages)
"""
