"""Operator 3: order-preserving packing by dynamic programming over window cuts.

Documents lie one after another in the order of their ids. A sequence is a window of at most `length` tokens of this
line, so the choice is where to cut. Cuts may fall between documents (free), after sentences (`SENTENCE` tokens'
worth of penalty) or, where none of these comes for `STRIDE` tokens, anywhere (`ANYWHERE`). With f(j) the least cost of
all up to cut j,

    f(j) = penalty(j) + min over i with p(j) - p(i) <= length of  f(i) + length - (p(j) - p(i)),

padding being linear in the positions p, so the minimum is one of f(i) + p(i) over a sliding window: a monotone queue
gives it in amortised constant time.

The line is cut into shards of about `SHARD_BYTES` of text by deterministic cuts of the order (more where over 50,000 of
them would be needed), within a null or repeated id too; a shard is one partition, a sorted run that a task walks, with `BLOCK` tokens (or one longer document) in memory at a time. What follows the last
window of a block is carried over into the next. Each shard ends with one partly filled sequence at most; a sequence of
2^k tokens isn't padded. Result and numbering depend on the input alone, not on the cluster.

Defined cases: null and empty texts are the closing id alone; null ids come first; documents alike in id are ordered
by a hash of their texts, then by text, and those alike in both lie in one shard; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 2048
CLOSING = 1
SENTENCE = 2
ANYWHERE = 12
STRIDE = 24
BLOCK = 1 << 18
SHARD_BYTES = 16 << 20


def byte_of() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, then from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Ids:
    """Ids of a byte-level tokenizer file of the `tokenizers` library.

    Its ids are in the order of its merges, so merging by rank gives the same ids; that is done here by tiktoken for
    texts of Latin script. Any other text (whose letters the two libraries' Unicode tables might class differently), and
    one that spells a special token, is encoded by `tokenizers` itself."""

    def __init__(self, path: str, pattern: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.other = re.compile(r"[^\x00-\u024f\u2010-\u2027]").search
        words, to_byte = {w: i for w, i in self.lib.get_vocab().items() if w not in self.special}, byte_of()
        ranks = {bytes(map(to_byte.__getitem__, w)): i for w, i in words.items()}
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.ends = np.zeros(self.lib.get_vocab_size(), dtype=bool)
        self.opens = np.zeros_like(self.ends)
        for w, i in words.items():  # in the vocabulary a space is U+0120, a newline U+010A
            self.ends[i] = w[-1] in ".!?\u010a"
            self.opens[i] = w[0] in "\u0120\u010a"

    def __call__(self, text: str) -> np.ndarray:
        if self.other(text) or any(s in text for s in self.special):
            ids = self.lib.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast(text)
        ids.append(CLOSING)
        return np.array(ids, dtype="<u4")

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of ids before the cuts that end a sentence."""
        return np.flatnonzero(self.ends[ids[:-1]] & self.opens[ids[1:]]) + 1


@lru_cache(maxsize=2)
def tokens(path: str, pattern: str) -> Ids:
    return Ids(path, pattern)


def candidates(sizes: list[int], sentences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the line may be cut and their penalties; the line's start isn't among them, its end is."""
    at, where, cost = 0, [], []
    for n, s in zip(sizes, sentences, strict=True):
        marks = np.concatenate([[0], s, [n]])
        gaps = np.diff(marks)
        extra = [np.arange(a + STRIDE, a + g, STRIDE) for a, g in zip(marks, gaps, strict=False) if g > STRIDE]
        every = np.concatenate([s, *extra, [n]]).astype(np.int64)
        price = np.full(len(every), ANYWHERE, dtype=np.float64)
        price[: len(s)] = SENTENCE
        price[-1] = 0
        order = np.argsort(every, kind="stable")
        where.append(every[order] + at)
        cost.append(price[order])
        at += n
    return np.concatenate(where), np.concatenate(cost)


def best_cuts(where: np.ndarray, cost: np.ndarray, length: int = LENGTH) -> list[int]:
    """Positions of the cuts of least total cost, the line's end included."""
    points, price = [0, *where.tolist()], [0.0, *cost.tolist()]
    total = [0.0] * len(points)
    back = [0] * len(points)
    queue = deque([(0.0, 0)])  # f(i) + p(i), rising; the front is the least in the window
    for j in range(1, len(points)):
        p = points[j]
        while points[queue[0][1]] < p - length:
            queue.popleft()
        least, i = queue[0]
        back[j] = i
        total[j] = f = least + length - p + price[j]
        key = f + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], len(points) - 1
    while j:
        cuts.append(points[j])
        j = back[j]
    return cuts[::-1]


def pack_run(documents: Iterator[tuple[object, np.ndarray, np.ndarray]], length: int = LENGTH) -> Iterator[list[tuple]]:
    """(id, ids, sentence ends) in order to sequences, each a list of (id, start, ids, document's tokens)."""
    line: list[tuple[object, int, np.ndarray, np.ndarray, int]] = []  # id, start, ids, cuts after sentences, document's tokens

    def flush(last: bool):
        nonlocal line
        if not line:
            return
        cuts = best_cuts(*candidates([len(x[2]) for x in line], [x[3] for x in line]), length)
        if not last:
            cuts = cuts[:-1]  # the last window may still grow
        k, off = 0, 0  # piece of the line, tokens of it that are used
        done = 0
        for c in cuts:
            seq, need = [], c - done
            while need:
                doc, start, ids, _, n = line[k]
                take = min(need, len(ids) - off)
                seq.append((doc, start + off, ids[off : off + take], n))
                need, off = need - take, off + take
                if off == len(ids):
                    k, off = k + 1, 0
            done = c
            yield seq
        rest = line[k:]
        if rest and off:
            doc, start, ids, ends, n = rest[0]
            rest[0] = (doc, start + off, ids[off:], ends[ends > off] - off, n)
        line = rest

    held = 0
    for doc, ids, ends in documents:
        line.append((doc, 0, ids, ends, len(ids)))
        held += len(ids)
        if held >= BLOCK:
            yield from flush(False)
            held = sum(len(x[2]) for x in line)
    yield from flush(True)


def pack(docs: DataFrame, tokenizer: str, pattern: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids (binary: little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    sequence_id is shard * 2^40 + number in the shard."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    cuts = common.ranges(rows, F.col("doc_id"), F.col("tie"), F.octet_length("text") + 1, SHARD_BYTES)
    rows = rows.select("doc_id", "text", "tie", cuts.of(F.col("doc_id"), F.col("tie")).alias("shard"))
    rows = rows.repartitionById(cuts.count, "shard").sortWithinPartitions("doc_id", "tie", "text")

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        ids_of, shard = tokens(tokenizer, pattern), [0]

        def read():
            for b in common.releasing(batches):
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    shard[0] = part.column(3)[0].as_py()
                    for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        ids = ids_of(text)
                        yield doc, ids, ids_of.sentence_ends(ids)

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        out = []
        for k, seq in enumerate(pack_run(read(), length)):
            off = 0
            for doc, start, ids, n in seq:
                out.append((doc, start, len(ids), ids.tobytes(), n, (shard[0] << 40) + k, off))
                off += len(ids)
            if len(out) >= 2000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
