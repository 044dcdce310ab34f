"""Operator 13: its counts against a plain reading, its sums and decoding against all labellings, and held-out labels."""

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from quillmill.llm import common, line_crf

SF = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:k] for k, x in enumerate(lines))
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    in_two = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    failed = len(words) < 20 or 100 * len(in_two) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(in_two), failed


def test_counts(spark):
    rng = random.Random(3)
    texts = [None, "", "\n\n", " \x0b \n", "one", "a b\na b\n\na b ", "é 中 文 😀 #*$%&|<>\x85x\r\ny", "w " * 400]
    for _ in range(60):
        u = [rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 40))]
        texts.append("".join(w + rng.choice([" ", "\n", "  ", "\t", "\n\n"]) for w in u * rng.randrange(1, 4)))
    for t in texts:
        m = line_crf.measure(t)
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.failed) == plain(t)
        full = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert m.bins.shape == (len(full), line_crf.WIDTH) and m.words.sum() == m.n_words
        assert all(line_crf.OFFSETS[j] <= x < line_crf.OFFSETS[j + 1] for row in m.bins.tolist() for j, x in enumerate(row))


def test_a_line_has_the_same_bins_in_any_text():
    lines = ["First line of words, plainly.", "SHOUT!! SHOUT!! AGAIN!!", "a | b | c | d", "12 34 same same same"]
    whole = line_crf.measure("\n".join(["start.", "", *lines, "  ", "end."])).bins
    for k, x in enumerate(lines):
        assert whole[k + 1][:-1].tolist() == line_crf.measure(x).bins[0][:-1].tolist()


def test_sums_and_decoding_over_all_labellings():
    rng = np.random.default_rng(1)
    for _ in range(20):
        field = line_crf.Field(rng.normal(size=line_crf.OFFSETS[-1]), rng.normal(size=(2, 2)))
        chains = [rng.integers(0, line_crf.OFFSETS[-1], (n, line_crf.WIDTH)) for n in (1, 4, 6)]
        (these, bins, size), *rest = line_crf._padded(chains)
        assert not rest and size.tolist() == [1, 4, 6]
        content, moves = line_crf._sums(field, bins, size)
        want = np.zeros((2, 2))
        for j, c in enumerate(chains):
            e = field.weights[c].sum(axis=1)
            scored = {y: sum(e[k] * v for k, v in enumerate(y)) + sum(field.moves[a, b] for a, b in itertools.pairwise(y)) for y in itertools.product((0, 1), repeat=len(c))}
            total = np.logaddexp.reduce(list(scored.values()))
            p = {y: np.exp(s - total) for y, s in scored.items()}
            assert np.allclose(content[j, : len(c)], [sum(q for y, q in p.items() if y[k]) for k in range(len(c))]) and not content[j, len(c) :].any()
            for y, q in p.items():
                for a, b in itertools.pairwise(y):
                    want[a, b] += q
            assert tuple(field.decode(c).astype(int)) == max(scored, key=scored.get)
        assert np.allclose(moves, want)


def test_held_out_labels(spark):
    docs, labels = common.table(spark, "/root/testdata/sf0.1", "documents"), common.table(spark, "/root/testdata/sf0.1", "labels")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    out = line_crf.label(docs, line_crf.train(docs, labels.where(~held))).join(labels.where(held), "doc_id").where("not base_failed").collect()
    good, poor = [r for r in out if r.quality == 1], [r for r in out if r.quality == 0]
    assert len(good) > 800 and len(poor) > 80
    assert sum(r.kept for r in good) >= 0.97 * len(good) and sum(not r.kept for r in poor) >= 0.8 * len(poor)


def test_lines_of_a_mixed_text(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    field = line_crf.train(docs, labels)
    good = "The thore of the anere is onthe that, and thoning as hered by the rest of it."
    mixed = "\n".join([good] * 4 + ["And %%% thing&&& ouer*** ther$$$ anded### of%%% the&&& ting*** onare$$$ ed###", "BUY!! NOW!! ALL!! OF!! IT!! BUY!! NOW!! ALL!! OF!! IT!!"])
    rows = line_crf.label(spark.createDataFrame([(1, "\n".join([good] * 3)), (2, mixed)], "doc_id long, text string"), field).orderBy("doc_id").collect()
    assert rows[0].lines == [True] * 3 and rows[1].lines[-2:] == [False, False] and rows[1].content_share < 1


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "short"), (None, "some words " * 30), (4, " ".join(f"w{k}" for k in range(50_000))), (4, " ".join(f"w{k}" for k in range(50_000)))]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, lines int, label string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, 1, None), (None, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(line_crf.label(docs, line_crf.train(docs, labels)).collect()) == len(rows)
    assert line_crf.train(docs, labels.where("quality = 1")) is None and line_crf.train(docs.limit(0), labels) is None
    got = {(r.doc_id, r.n_words): (r.base_failed, r.kept) for r in line_crf.label(docs, None).collect()}
    assert got == {(1, 0): (True, False), (2, 0): (True, False), (3, 1): (True, False), (None, 60): (True, False), (4, 50_000): (False, True)}
    assert line_crf.label(docs.limit(0), None).collect() == []


def test_a_sample_of_any_number_is_never_empty(spark):
    df = spark.range(5000).select(F.col("id"))
    got = [r.id for r in common.few(df, 100).collect()]
    assert len(set(got)) == 100 and got == [r.id for r in df.orderBy(F.xxhash64("id")).limit(100).collect()]
    for n in (6001, 10**7, 10**13, 10**18):
        assert min(n, 6600) - 1 <= (common.hash_bound(n, 6000) + 2**63) * n / 2**64 <= 6701 and common.hash_bound(n, 6000) < 2**63
