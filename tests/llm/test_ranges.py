"""Cuts of an order into ranges, and the operators that use them, over several ranges against brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillmill.llm import common, packing, sharding, warc
from quillmill.plans.scratch import scratch

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def docs(spark):
    """A third without an id, a third under one id, empty and equal texts among them."""
    rng, rows = random.Random(5), []
    for k in range(600):
        text = rng.choice([None, "", "same words every time", *[" ".join(rng.choices(["ab", "cde.", "fgh", "i!"], k=rng.randint(1, 60)))] * 5])
        rows.append((None if k % 3 == 0 else 7 if k % 3 == 1 else k, text, "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(4).cache()


def order(key):
    return (key[0] is not None, key[0] or 0, *key[1:])


def test_find_is_a_count_of_cuts():
    rng = random.Random(2)
    for _ in range(50):
        draw = lambda: (rng.choice([None, 0, *range(-3, 4)]), rng.randint(-3, 3))
        cuts = sorted({draw() for _ in range(rng.randint(1, 12))}, key=order)
        keys = [draw() for _ in range(40)]
        got = common.Ranges(cuts).find(np.array([i or 0 for i, _ in keys]), np.array([i is None for i, _ in keys]), np.array([t for _, t in keys]))
        assert got.tolist() == [sum(order(c) <= order(k) for c in cuts) for k in keys]


def test_the_sample_of_keys_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(common, "KEYS", 400)
    df = spark.range(20_000)
    cuts = common.ranges(df, F.col("id"), F.lit(0).cast("long"), F.lit(1), 10)
    assert 20 < cuts.count <= 50
    sizes = [r[1] for r in df.groupBy(cuts.of(F.col("id"), F.lit(0).cast("long"))).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 20 * min(sizes)


def test_rows_get_the_slots_of_their_numbers(spark, docs):
    """Row numbers by a plain sort; shard and slot by a plain Feistel walk."""
    every = sorted(((r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 1) for r in docs.collect()), key=order)
    n, m = len(every), (1 << 64) - 1

    def mix(x, key):
        x = (x + key) * 0x9E3779B97F4A7C15 & m
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m
        return x ^ x >> 31

    half = -(-(n - 1).bit_length() // 2)
    low = (1 << half) - 1

    def image(x):
        while True:
            left, right = x >> half, x & low
            for r in range(6):
                left, right = right, left ^ mix(right, mix(20240229 * 64 + r, 0)) & low
            x = left << half | right
            if x < n:
                return x

    want = sorted((*key, image(k) % 16, image(k) // 16) for k, key in enumerate(every) if every.count(key) == 1 for key in [(str(key[0]), *key[1:])])
    got = sharding.shard(docs).collect()
    assert sorted((r.shard, r.slot) for r in got) == sorted((p % 16, p // 16) for p in range(n))
    single = {(str(k[0]), *k[1:]) for k in every if every.count(k) == 1}
    assert sorted(t for r in got if (t := (str(r.doc_id), r.text_crc32, r.size, r.shard, r.slot))[:3] in single) == want
    # the Feistel image doesn't depend on the number of ranges
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 37)
    assert sorted(map(str, sharding.shard(docs).collect())) == sorted(map(str, got))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_packing_over_shards(docs, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_BYTES", 2000)
    ids = packing.Ids(PATH, PATTERN)
    out = sorted(packing.pack(docs, PATH, PATTERN, 64).collect(), key=lambda r: (r.sequence_id, r.offset))
    assert len({r.sequence_id >> 40 for r in out if r.doc_id is None}) > 2 and len({r.sequence_id >> 40 for r in out if r.doc_id == 7}) > 2
    at, full, held = None, [], b""
    for r in out:  # pieces in order are whole documents, one after another
        assert r.offset == (at[1] if at and at[0] == r.sequence_id else 0) and r.offset + r.length <= 64
        at = (r.sequence_id, r.offset + r.length)
        assert r.start == len(held) // 4
        held += r.ids
        if r.start + r.length == r.doc_tokens:
            full.append((r.doc_id, held))
            held = b""
    assert not held and [k for k, _ in full] == sorted((k for k, _ in full), key=lambda k: order((k,)))
    want = [(r.doc_id, ids(r.text or "").tobytes()) for r in docs.collect()]
    assert sorted(map(str, full)) == sorted(map(str, want))


def test_archives_over_shards(spark, monkeypatch):
    """Revisits name responses of other shards; one payload has a third of all rows; long payloads are whole."""
    monkeypatch.setattr(warc, "SHARD_BYTES", 40_000)
    rng, rows = random.Random(9), []
    for k in range(200):
        body = "copied " * 300 if k % 3 == 0 else "y" * 300_000 if k == 100 else "".join(rng.choices("abc", k=rng.choice([0, 10, 999, 1000, 3000])))
        rows.append((None if k % 7 == 1 else 5 if k % 7 == 2 else k, "u" * (100_000 if k == 50 else 3), body))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = scratch(spark, "warc-test")
    manifest = sorted(map(tuple, warc.write(pages, folder, roll=5000).collect()))
    assert len({m[1] for m in manifest}) > 4
    same = {}
    for i, _, body in rows:
        same.setdefault(body, []).append(i)
    want = []
    for i, url, body in rows:
        top = max((x for x in same[body] if x is not None), default=None)
        revisit = len(body) >= 1000 and i != top
        want.append((i, url, "revisit" if revisit else "response", top if revisit else None, len(body), hashlib.sha1(body.encode()).hexdigest(), b"" if revisit else body.encode()))
    key = lambda r: tuple(map(str, r))
    got = [(*r[:6], bytes(r[6])) for r in warc.read(spark, folder).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    # an attempt that comes again finds its names taken and writes the same
    assert sorted(map(tuple, warc.write(pages, folder, roll=5000).collect())) == manifest
    assert sorted(((*r[:6], bytes(r[6])) for r in warc.read(spark, folder).collect()), key=key) == sorted(want, key=key)


def test_copies_of_a_row_are_numbered_in_steps(spark, monkeypatch):
    """A row that is most of the table takes consecutive numbers, given out in steps."""
    rows = [(None, None)] * 700 + [(5, "x")] * 333 + [(k, f"t{k % 3}") for k in range(200)] + [(5, "y")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    whole = sorted(tuple(r) for r in sharding.shard(df).select("row", "doc_id", "size", "text_crc32", "shard", "slot").collect())
    monkeypatch.setattr(sharding, "COPIES", 50)
    monkeypatch.setattr(sharding, "RANGE_ROWS", 40)
    out = sharding.shard(df)
    assert sorted(tuple(r) for r in out.select("row", "doc_id", "size", "text_crc32", "shard", "slot").collect()) == whole
    assert [r[0] for r in whole] == list(range(len(rows)))
    keys = [(r[1] is not None, r[1] or 0, r[3], r[2]) for r in whole]
    assert keys == sorted(keys) and sorted((r[4], r[5]) for r in whole) == sorted((p % 16, p // 16) for p in range(len(rows)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert max(out.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 0.6 * len(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
