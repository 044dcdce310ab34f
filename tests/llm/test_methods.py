"""The operators' methods against brute force, public libraries and held-out labels."""

import random

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.llm import ann, bpe, near_dup, packing, quality, sharding, toxicity

DATA = "/root/testdata/sf0.01"
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIB = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXT = st.text(st.one_of(st.sampled_from("aeioths nr.\n'0é中😀"), st.characters(exclude_categories=["Cs"])), max_size=80)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.sampled_from([1, 50, 100_000]))
def test_encoding_is_the_librarys(text, states):
    enc, dec = bpe.Encoder.__new__(bpe.Encoder), bpe.Decoder(RANKS)
    enc.__dict__ |= machines[states].__dict__
    assert enc(text) == LIB.encode_ordinary(text) and dec(enc(text)) == text


machines = {}
for n in (1, 50, 100_000):
    machines[n] = bpe.Encoder(RANKS, public_tokenizers.PATTERN, pieces=4)
    machines[n].machine.max_states = n


def test_long_pieces():
    for text in ("a" * 9000 + "b", "ab" * 5000, "Ünïcödé" * 1500, " " * 5000 + "x", "=" * 9000):
        assert machines[50](text) == LIB.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=12))
def test_streaming_decode_of_any_bytes(data):
    dec = bpe.Decoder(RANKS)
    ids = [RANKS[bytes([x])] for x in data]
    whole = "".join(dec.feed(ids)) + dec.finish()
    try:
        assert whole == data.decode("utf-8")
    except UnicodeDecodeError:
        assert "�" in whole


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 1 << 40))
def test_feistel_is_a_permutation(n, key):
    x = np.arange(n)
    p = sharding.permute(x, n, key)
    assert sorted(p.tolist()) == list(range(n))
    shard, slot = sharding.place(x, n, 16, key)
    assert (sharding.locate(shard, slot, n, 16, key) == x).all()
    assert np.ptp(np.bincount(shard, minlength=16)) <= 1


def test_cuts_are_the_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        where = np.cumsum([rng.randint(1, 40) for _ in range(rng.randint(1, 40))])
        cost = np.array([rng.choice([0.0, 2.0, 12.0]) for _ in where])
        points, price, best = [0, *where.tolist()], [0.0, *cost.tolist()], [0.0]
        for j in range(1, len(points)):
            best.append(min(best[i] + 64 - (points[j] - points[i]) for i in range(j) if points[j] - points[i] <= 64) + price[j])
        cuts, at, total = packing.best_cuts(where, cost, 64), 0, 0.0
        for c in cuts:
            total, at = total + 64 - (c - at) + price[points.index(c)], c
        assert cuts[-1] == points[-1] and abs(total - best[-1]) < 1e-9


def test_packing_ids_are_the_tokenizers(spark):
    ids = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    for t in [*texts[::7], "<|endoftext|> x", "中文 text", "a b  c\t\td'll we've"]:
        assert ids(t).tolist() == [*ids.lib.encode(t, add_special_tokens=False).ids, 1]


def test_packing_leaves_little_padding(spark):
    out = packing.pack(spark.read.parquet(f"{DATA}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).drop("ids").collect()
    total = sum(r.length for r in out)
    assert 1 - total / (2048 * len({r.sequence_id for r in out})) < 0.02


def test_near_groups_are_brute_forces(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sets = {r.doc_id: near_dup.shingles(r.text) for r in docs.collect()}
    ids, root = sorted(sets), {}
    top = lambda x: x if root.get(x, x) == x else top(root[x])
    values, at = np.unique(np.concatenate([sets[i] for i in ids]), return_inverse=True)
    owner = np.repeat(np.arange(len(ids)), [len(sets[i]) for i in ids])
    order = np.argsort(at, kind="stable")
    seen = {}
    for v, o in zip(at[order], owner[order], strict=True):
        seen.setdefault(v, []).append(o)
    pairs = {(a, b) for os in seen.values() if len(os) > 1 for a in os for b in os if a < b}
    for a, b in pairs:
        x, y = sets[ids[a]], sets[ids[b]]
        both = len(np.intersect1d(x, y))
        if 100 * both >= 85 * (len(x) + len(y) - both):
            p, q = top(ids[a]), top(ids[b])
            root[max(p, q)] = min(p, q)
    got = {r.doc_id: r.component_id for r in near_dup.groups(docs).collect()}
    assert got == {i: top(i) for i in ids}


def test_deep_paths_and_blocks(spark, monkeypatch):
    """Small limits drive the same data through all levels, dense nodes and pairs of blocks."""
    monkeypatch.setattr(near_dup, "SMALL", 4)
    monkeypatch.setattr(near_dup, "BLOCK", 5)
    rng, base, rows = random.Random(1), [f"w{k}" for k in range(120)], []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    sets = {i: near_dup.shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    top = lambda x: x if root[x] == x else top(root[x])
    for i in sets:
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in near_dup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: top(i) for i in sets}


def test_ann_recall(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet")
    got = ann.search(rows, rows.where("vec_id % 5 = 0")).collect()
    data = rows.collect()
    ids, x = np.array([r.vec_id for r in data]), np.array([r.embedding for r in data], dtype=np.float64)
    unit, hit = x / np.linalg.norm(x, axis=1)[:, None], 0
    for q in ids[ids % 5 == 0]:
        s = unit @ unit[ids == q][0]
        s[ids == q] = -2
        near = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        hit += sum(r.vec_id in near for r in got if r.query_id == q)
    assert hit / len(got) >= 0.9


def test_classifiers_on_held_out_rows(spark):
    d = DATA.replace("0.01", "0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = {r.doc_id: r for r in toxicity.query(spark, d).collect()}
    marks = [(out[r.doc_id], r.toxic) for r in labels.collect() if out[r.doc_id].held_out]
    assert sum(p.predicted == y for p, y in marks) / len(marks) > 0.97
    assert sum(p.predicted for p, y in marks if not y) <= 2
    known = labels.where("doc_id % 4 != 0")
    scored = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, known)).collect()}
    rest = [(scored[r.doc_id] >= 0.5, r.quality) for r in labels.where("doc_id % 4 = 0").collect()]
    assert sum(p == bool(y) for p, y in rest) / len(rest) > 0.98


def test_the_machine_learns_pairs():
    """Toxic only if both terms occur: no sum of weights tells it."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array(sorted({*([7] if a else []), *([9] if b else []), *rng.integers(100, 130, 3).tolist()}), dtype=np.int32))
        labels.append(float(a and b))
    m = toxicity.fit(rows, np.array(labels))
    assert m.score(np.array([7, 9])) > 0.9 > 0.2 > max(m.score(np.array([7])), m.score(np.array([9])))
