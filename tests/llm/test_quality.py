"""Co-training takes all unlabelled rows, and its exchange is what lets few labels do."""

import numpy as np
import pytest

from quillmill.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def two_views(spark):
    """Two views that tell the label independently: each text has a few words of its class out of 500; half of the sources
    lean to a class, the others to none. 300 rows have labels, so most words are unknown at first."""
    rng, rows = np.random.default_rng(3), []
    for i in range(8000):
        good = i % 2
        words = [*(f"c{k}" for k in rng.integers(0, 50, 8)), *(f"{'pq'[good]}{k}" for k in rng.integers(0, 500, 4))]
        rng.shuffle(words)
        lean = rng.integers(0, 4) + 4 * (good if rng.random() < 0.99 else 1 - good)
        rows.append((i, " ".join(words), "en", f"s{lean if rng.random() < 0.5 else 8 + rng.integers(0, 4)}", 100))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).cache()
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    return docs, labels


def accuracy(docs, model, column):
    got = [(r[column] >= 0.5, r.doc_id % 2) for r in quality.score(docs, model).collect() if r.doc_id >= 300]
    return sum(p == bool(y) for p, y in got) / len(got)


def test_the_exchange_teaches_the_text_view(two_views):
    docs, labels = two_views
    alone, taught = (quality.train(docs, labels, rounds=r) for r in (0, quality.ROUNDS))
    assert accuracy(docs, taught, "text_score") > accuracy(docs, alone, "text_score") + 0.1
    assert accuracy(docs, taught, "score") > accuracy(docs, alone, "score") + 0.05
    assert accuracy(docs, taught, "score") > accuracy(docs, taught, "meta_score")


def test_all_unlabelled_rows_are_scored_and_handed_over_in_proportion(spark, monkeypatch):
    """Far more unlabelled rows than labelled ones may be in the sample: what is handed over grows with them."""
    good = [(i, f"This is sentence {i} of a plain text. It has words like house{i % 7} and tree{i % 11}, and it ends.", "en", "a", 90) for i in range(2000)]
    bad = [(5000 + i, "!!! | $$ ## " * (3 + i % 9), "en", "b", 60) for i in range(500)]
    docs = spark.createDataFrame(good + bad, SCHEMA).repartition(5)
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(5000 + i, 0) for i in range(20)], "doc_id long, quality int")
    counts, hand_over = [], quality._hand_over

    def spy(pool, *how):
        n = pool.count()
        left, gone = hand_over(pool, *how)
        counts.append((n, left.count(), gone.count()))
        return left, gone

    monkeypatch.setattr(quality, "_hand_over", spy)
    out = quality.score(docs, quality.train(docs, labels, sample=100)).collect()
    assert all((r.score >= 0.5) == (r.doc_id < 5000) for r in out) and len(out) == 2500
    assert counts[0][0] == 2420 and all(n == left + gone for n, left, gone in counts) and all(a[1] == b[0] for a, b in zip(counts, counts[1:], strict=False))
    assert len(counts) == 4 and sum(gone for *_, gone in counts) > 4 * 2 * 0.05 * 100 and counts[0][2] <= 2 * 0.05 * 2420 + 2


def test_sums_over_many_tasks(spark):
    df = spark.range(1000).repartition(70)
    for deep in (False, True):
        assert quality._added(df, (2,), lambda b: np.array([b.num_rows, sum(b.column(0).to_pylist())], dtype=float), deep).tolist() == [1000, 499_500]


def test_measures_count_characters_alike_at_any_length():
    """Letters are `isalpha`, capitals `isupper`, in any script, also beyond 16 bits, in short texts and long ones."""
    for unit in ("²½ ", "Ab é ", "ДЖ д ", "𝐀𝐛 x ", "😀 a ", "中文 "):
        for n in (1, 500):
            text = unit * n
            words, x = text.split(), quality.features(text)[0]
            letters, upper = sum(map(str.isalpha, text)), sum(c.isupper() for c in text if c.isalpha())
            odd = sum(not c.isalnum() and not c.isspace() and c not in "_.,;:'\"()-" for c in text)
            assert x[12] == letters / len(words) and x[6] == upper / max(1, letters) and x[7] == odd / len(text)


def test_measures_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        words = [str(w) for w in rng.choice(["a", "B", "cc!", "|", "9", "a.b?"], rng.integers(1, 30))]
        text = "".join(w + rng.choice([" ", "\n", "  "]) for w in words)
        x, terms = quality.features(text)
        pairs, run, longest = set(zip(words, words[1:], strict=False)), 1, 1
        for a, b in zip(words, words[1:], strict=False):
            run = run + 1 if a == b else 1
            longest = max(longest, run)
        n, lines = len(words), text.split("\n")
        want = [np.log1p(n), len(set(words)) / n**0.9, max(map(words.count, words)) / n, longest / n, longest, len(pairs) / n]
        assert np.allclose(x[:6], want) and x[9:12] == [text.count("|") / n, text.count("!") / n, text.count("9") / len(text)]
        assert np.isclose(x[13], len(set(lines)) / len(lines)) and x[14] == sum(map(text.count, "!.?")) / n
        assert len(terms) <= len(set(words)) + len(pairs) and (np.diff(terms.astype(int)) > 0).all()
    assert quality.features(None)[0] == quality.features(" \n")[0] == [0.0] * quality.MEASURES


def test_a_view_that_tells_nothing_hands_over_nothing(spark):
    """Sources dealt by chance: the metadata view stays at the base rate, and the result is the text view's."""
    rng = np.random.default_rng(2)
    rows = [(i, ("plain words here. " if i % 5 else "zz !! ") * (1 + i % 4) + f"n{i}", "en", f"s{rng.integers(0, 20)}", 50) for i in range(1500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(400)], "doc_id long, quality int")
    out = quality.score(docs, quality.train(docs, labels)).collect()
    assert all(0.5 < r.meta_score < 0.97 for r in out) and all((r.score >= 0.5) == (r.doc_id % 5 > 0) for r in out)


def test_chunks_change_nothing(monkeypatch):
    text = " ".join(["a" * 40, "bb", "é中", "x\ty\r\nz", "", "bb"] * 30)
    whole = quality.features(text)
    for n in (1, 7, 100):
        monkeypatch.setattr(quality, "CHUNK", n)
        x, terms = quality.features(text)
        assert x == whole[0] and (terms == whole[1]).all()


def test_sums_of_many_partitions_reach_the_driver_as_few(spark, monkeypatch):
    frame, sent = type(spark.range(0)), []
    monkeypatch.setattr(frame, "collect", lambda self, f=frame.collect: (sent.append(out := f(self)), out)[1])
    got = quality._added(spark.range(0, 1000, 1, 60), (3,), lambda b: np.full(3, float(sum(b.column(0).to_pylist()))))
    assert got.tolist() == [499500.0] * 3 and len(sent[0]) <= quality.FEW
