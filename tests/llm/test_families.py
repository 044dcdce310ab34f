"""Large families of near copies: linear work, and no component lost around the threshold."""

import random

import numpy as np
import pytest

from quillmill.llm import near_dup


def brute(rows):
    sets, root = {i: near_dup.shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if j < i:
                both = len(np.intersect1d(sets[i], sets[j]))
                if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = top(i), top(j)
                    root[max(a, b)] = min(a, b)
    return {i: top(i) for i in sets}


@pytest.mark.parametrize("most", [2, 5, 9])
def test_families_around_the_threshold(spark, monkeypatch, most):
    """Members of one star, of several, and of none, in nodes of several blocks."""
    monkeypatch.setattr(near_dup, "SMALL", 4)
    monkeypatch.setattr(near_dup, "BLOCK", 6)
    monkeypatch.setattr(near_dup, "PIVOTS", 16)
    rng, rows = random.Random(most), []
    base = [f"w{k}" for k in range(150)]
    for f in range(4):  # centres some way apart
        centre = list(base)
        for k in range(f * 3):
            centre[rng.randrange(150)] = f"c{f}-{k}"
        for i in range(18):
            words = list(centre)
            for _ in range(rng.randint(0, most)):
                words[rng.randrange(150)] = f"x{f}-{i}"
            rows.append((100 * f + i, " ".join(words)))
    want = brute(rows)
    got = {r.doc_id: r.component_id for r in near_dup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and 1 < len(set(want.values())) < len(rows) or most == 2 and got == want


def test_a_family_takes_linear_work(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 16)
    monkeypatch.setattr(near_dup, "BLOCK", 20)
    rng, rows = random.Random(7), []
    for i in range(1500):
        words = [f"w{k}" for k in range(200)]
        words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    compared, beside, count = near_dup._compared, near_dup._beside_pivots, {}

    def spy(name, of):
        def run(df, percent):
            count[name] = df.count()
            return of(df, percent)

        return run

    monkeypatch.setattr(near_dup, "_compared", spy("blocks", compared))
    monkeypatch.setattr(near_dup, "_beside_pivots", spy("pivots", beside))
    got = near_dup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}
    # a few families of nearly all members, and 16 pivots to each block of 20
    assert count["pivots"] < 6 * 1500 * (1 + 16 / 20) and count["blocks"] < 3 * 1500


def test_blocks_are_bounded_in_bytes(spark):
    df = spark.createDataFrame([(600, 1000), (2, 100_000_000), (3, 10), (1000, 64 << 20)], "size long, total long")
    assert [r[0] for r in df.select(near_dup._blocks("size", "total")).collect()] == [2, 2, 1, 16]
