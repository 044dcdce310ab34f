"""Links of long texts: found many pairs at once, and the same as by whole subsequences."""

import random

from quillmill.operators import dedup


def edited(t, rate, of):
    return "".join(c if of.random() > rate else of.choice(["", "x", c + "y"]) for c in t)


def made(sizes, of):
    texts = ["".join(of.choice("abcdefgh ") for _ in range(n)) for n in sizes]
    out = [x for t in texts for x in (t, edited(t, 0.1, of), "z" * (len(t) // 8) + t, t[len(t) // 6 :], t + "z" * (len(t) // 8))]
    return list(enumerate(dict.fromkeys(out)))


def test_long_texts_are_not_compared_one_by_one(monkeypatch):
    rows, called = made([9000 + k for k in range(6)], random.Random(1)), []
    one = dedup.ratio
    monkeypatch.setattr(dedup, "ratio", lambda *a: called.append(a) or one(*a))
    got = dedup._links(rows, None, 0.85)
    assert {(i, j) for i, j, _ in got} >= {(k, k + 1) for k in range(0, len(rows), 5)}
    assert not called


def test_links_as_by_whole_subsequences(monkeypatch):
    rows = made([40, 64, 65, 130, 300, 700] * 8, random.Random(2))
    monkeypatch.setattr(dedup, "FEW", 1)
    for threshold in (0.6, 0.85):
        want = {(i, j) for i, a in rows for j, b in rows if i < j and 2 * dedup.lcs(a, b) >= threshold * (len(a) + len(b)) - 1e-9}
        assert {(i, j) for i, j, _ in dedup._links(rows, None, threshold)} == want
        assert {(i, j) for i, j, _ in dedup._links(rows[::2], rows[1::2], threshold)} == {(i, j) for i, j in want if i % 2 != j % 2}
