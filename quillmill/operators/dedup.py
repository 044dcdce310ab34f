"""Exact and near-duplicate removal over ordered samples.

Near duplicates are pairs whose normalised Indel similarity, 1 - (|a| + |b| - 2 LCS) / (|a| + |b|), reaches the threshold.
Equal texts are collapsed first. Texts are dealt into blocks of one or more bands of the logarithm of the length; two blocks whose
lengths allow the threshold meet in a task, which holds both and no more. There pairs pass bounds by lengths and character
counts before the longest common subsequence is computed by bit-parallel arithmetic, many pairs at once, with counts of the
rests as bounds on the way; every pair at or above the threshold is found, and only those leave the task. The (compressed)
texts are shuffled into blocks, however many theirs meets: tasks are a cartesian product of the blocks and read two of them
where they lie. The pairs compared grow with a band's square: this is the exact operator, for sets of moderate size.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.operators.components import components
from quillmill.plans.scratch import remove, scratch, written

THRESHOLD = 0.85
LETTERS = "etaoinshrdlucmfgpb ,."
#: Texts of a block, and bytes of its compressed ones; a task holds several copies of these on their way to Python.
ROWS, BYTES = 1 << 15, 8 << 20
#: Texts of so many characters are compared many pairs at once: so many are collected, and go in groups with so many words at work, by tables of so many
#: words; longer ones, and groups of fewer pairs, one by one.
SHORT, TOGETHER, LANES, CELLS, FEW = 60_000, 1 << 16, 1 << 14, 1 << 22, 16


def exact(samples: DataFrame, field: str = "instruction") -> DataFrame:
    """The samples with `removed`: true for all but the first of equal field values."""
    first = F.min("idx").over(Window.partitionBy(F.sha2(F.coalesce(F.col(field).cast("string"), F.lit("")), 256)))
    return samples.withColumn("removed", F.col("idx") > first)


def unique(samples: DataFrame, field: str = "instruction") -> DataFrame:
    """The first sample of each field value, by a partial minimum before the shuffle and a semi join on idx."""
    key = F.sha2(F.coalesce(F.col(field).cast("string"), F.lit("")), 256)
    keep = samples.groupBy(key.alias("__key")).agg(F.min("idx").alias("idx")).select("idx")
    return samples.join(keep, "idx", "left_semi")


def _places(a: str) -> dict[str, int]:
    """The places of each character, as bits."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    return where


def lcs(a: str, b: str, need: int = 0, where: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, a machine integer's bit for each character of a; -1 if below `need`.

    A common subsequence of `need` characters leaves out len(a) - need of a, so after i characters of b it is at most that
    far ahead in a; what both have in common up to there, and the rest of b, bound it. where: the places of a, if known."""
    where = _places(a) if where is None else where
    mask = s = (1 << len(a)) - 1
    for at in range(0, len(b), 64):
        for c in b[at : at + 64]:
            u = s & where.get(c, 0)
            s = ((s + u) | (s - u)) & mask
        done = min(at + 64, len(b))
        ahead = min(len(a), max(0, done + len(a) - need))
        if ahead - (s & ((1 << ahead) - 1)).bit_count() + len(b) - done < need:
            return -1
    found = len(a) - s.bit_count()
    return found if found >= need else -1


def ratio(a: str, b: str, threshold: float = 0.0, where: dict[str, int] | None = None) -> float:
    """Similarity, or 0 if it is below the threshold."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    found = lcs(a, b, max(0, math.floor(threshold * total / 2 - 1e-6)), where)
    return 0.0 if found < 0 else 1.0 - (total - 2 * found) / total


class _Side(NamedTuple):
    """Texts of a block for `_lcs_of_pairs`: their characters' codes from 1 on, one text after another and a 0, and their letter counts.

    after: the letters from each 32nd place on, a column for each, from a text's `first` to its `last` of none."""

    texts: list[str]
    codes: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    after: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _sides(sides: list[list[str]], counts: list[np.ndarray]) -> list[_Side]:
    """Texts of over SHORT characters stay without codes, and all but the last side's without letters of their rests."""
    used = sorted({c for texts in sides for c in set().union(*(t for t in texts if len(t) <= SHORT))})
    points = np.array([ord(c) for c in used], dtype=np.int64)
    code = np.zeros(int(points.max(initial=0)) + 1, dtype=np.uint8 if len(used) < 255 else np.uint32)
    code[points] = np.arange(1, len(used) + 1)
    out = []
    for texts, of in zip(sides, counts, strict=True):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(np.where(sizes <= SHORT, sizes, 0))
        codes = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, dtype=code.dtype)
        for t, end in zip(texts, ends.tolist(), strict=True):
            if 0 < len(t) <= SHORT:
                codes[end - len(t) : end] = code[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        coded = np.where(sizes <= SHORT, sizes, 0)
        starts, last, classes = ends - coded, np.cumsum((coded + 31) // 32 + 1) - 1, np.append(0, _classes(points))
        first = last - (coded + 31) // 32
        after = _rests(codes, classes, starts, coded, first, last, len(of)) if texts is sides[-1] else np.zeros((len(of), 0), dtype=np.uint8)
        out.append(_Side(texts, codes, starts, sizes, of, classes, after, first, last))
    return out


def _rests(codes: np.ndarray, classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, last: np.ndarray, kinds: int) -> np.ndarray:
    """`after` of a side, made of about a million characters at a time."""
    out = np.zeros((kinds, int(last[-1]) + 1 if len(last) else 0), dtype=np.uint8 if sizes.max(initial=0) < 256 else np.uint16)
    parts = np.flatnonzero(np.diff(starts >> 20, prepend=-1)).tolist()
    for k, end in zip(parts, [*parts[1:], len(starts)], strict=True):
        n, base, cells = sizes[k:end], int(first[k]), int(last[end - 1] - first[k]) + 1
        owner = np.repeat(np.arange(k, end), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of = classes[codes[int(starts[k]) : int(starts[k] + n.sum())]]
        sums = np.bincount(of * cells + first[owner] - base + place // 32, minlength=kinds * cells).reshape(kinds, cells)
        sums = sums[:, ::-1].cumsum(axis=1)[:, ::-1]
        out[:, base : base + cells] = sums - sums[:, np.repeat(last[k:end] - base, last[k:end] - first[k:end] + 1)]
    return out


def _similar(left: _Side, right: _Side, ks: np.ndarray, js: np.ndarray, threshold: float) -> Iterator[tuple[int, float]]:
    """Number and similarity of the pairs (ks, js) that reach the threshold. Pairs of like lengths go together, and of those the ones with like differences of lengths."""
    n, sizes = left.sizes, right.sizes
    words = (n[ks] + 63) // 64
    like = np.ceil(2 * np.log2(words)).astype(np.int64)
    order = np.lexsort((sizes[js] - n[ks], like))
    ends = np.flatnonzero(np.diff(like[order], append=-1)) + 1
    for start, end in zip(np.append(0, ends)[:-1].tolist(), ends.tolist(), strict=True):
        group = order[start:end]
        lanes = max(2 * FEW, int(LANES // (1 + words[group].max() * 2 * (1 - threshold))))
        parts = [(None, group)] if len(group) < FEW else ((part, group[np.isin(ks[group], part.texts)]) for part in _tables(left, np.unique(ks[group])))
        for part, those in parts:
            for at in range(0, len(those), lanes):
                some = those[at : at + lanes]
                if len(some) < FEW:
                    k, where = -1, {}
                    for x in some[np.argsort(ks[some], kind="stable")].tolist():
                        if ks[x] != k:
                            k, where = ks[x], _places(left.texts[ks[x]])
                        if (sim := ratio(left.texts[k], right.texts[js[x]], threshold, where)) >= threshold:
                            yield x, sim
                    continue
                total = n[ks[some]] + sizes[js[some]]
                need = np.maximum(0, np.floor(threshold * total / 2 - 1e-6).astype(np.int64))
                found = _lcs_of_pairs(part, right, np.searchsorted(part.texts, ks[some]), js[some], need)
                sim = np.where(found < 0, 0.0, 1.0 - (total - 2 * found) / total)
                yield from ((int(some[x]), float(sim[x])) for x in np.flatnonzero(sim >= threshold))


class _Table(NamedTuple):
    """Left texts for `_lcs_of_pairs`: the places of each character in each, as bits, and the letters from each grid-th place on."""

    texts: np.ndarray
    sizes: np.ndarray
    places: np.ndarray
    code: np.ndarray
    kinds: int
    grid: int
    after: np.ndarray


def _tables(left: _Side, texts: np.ndarray) -> Iterator[_Table]:
    """Tables of CELLS words at most, or of one text."""
    n = left.sizes[texts]
    owner, place = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    x = left.codes[left.starts[texts][owner] + place]
    code = np.zeros(len(left.classes), dtype=np.int32)
    code[x] = 1
    kinds = np.count_nonzero(code) + 1
    code[code > 0] = np.arange(1, kinds)  # 0: in no left text
    words = int(n.max() + 63) // 64
    if words * len(n) * kinds > CELLS and len(n) > 1:
        h = len(n) // 2
        yield from _tables(left, texts[:h])
        yield from _tables(left, texts[h:])
        return
    places = np.zeros((words, len(n) * kinds), dtype=np.uint64)
    np.bitwise_or.at(places, (place // 64, owner * kinds + code[x]), np.uint64(1) << (place % 64).astype(np.uint64))
    grid = 16 << (words // 16).bit_length()
    cells, classes = words * 64 // grid + 2, len(left.counts)
    after = np.bincount((place // grid * classes + left.classes[x]) * len(n) + owner, minlength=cells * classes * len(n)).reshape(cells, classes, len(n))
    yield _Table(texts, n, places, code, kinds, grid, after[::-1].cumsum(axis=0)[::-1].astype(np.uint16 if n.max() < 1 << 16 else np.int32))


def _lcs_of_pairs(left: _Table, right: _Side, ks: np.ndarray, js: np.ndarray, need: np.ndarray) -> np.ndarray:
    """`lcs` of each pair, -1 if below its need: the same arithmetic in 64-bit words, a step for a character of all right texts.

    A subsequence of that length strays from the diagonal by the characters left out at most, so only words there take part. A word
    is a step behind the word before it, whose carry it needs: so all words of all pairs are worked on at once.
    After some characters of the right texts it is split: what they have in common with the left text up to a place, and no more
    after it than the letters that both rests share. A pair goes on while that is enough for some place near the diagonal, and
    the words narrow down to places where the lengths of the rests are."""
    n, m, starts, base = left.sizes[ks], right.sizes[js], right.starts[js], ks * left.kinds
    places, grid, words, steps, last = left.places, left.grid, len(left.places), int(m.max(initial=0)), len(right.codes) - 1
    bits, each = min(64, grid), max(32, steps // 512 * 32)  # each: steps from bound to bound
    kind, first_rest, last_rest = max(left.after.dtype, right.after.dtype), right.first[js], right.last[js]
    flat, row = places.ravel(), (np.arange(words) * places.shape[1])[:, None]
    lanes, found = np.arange(len(ks)), np.full(len(ks), -1, dtype=np.int64)
    s, done = np.full((words, len(ks)), ~np.uint64(0)), 0
    low = high = int(left.sizes.max()) + steps
    while len(lanes):
        low, high = min(low, int((m - need).max())), min(high, int((n - need).max()))
        ahead = min(done + (each if done or words < 4 else max(each, 64)), steps)
        k = np.arange(done, ahead)[:, None]
        at = left.code[right.codes[starts + k if ahead <= m.min() else np.where(k < m, starts + k, last)]] + base
        most = max(0, min(words, (ahead - 1 + high) // 64 + 1) - max(0, done - low) // 64)
        index, us, ts = (np.empty((most, len(lanes)), dtype=x) for x in (np.int64, np.uint64, np.uint64))
        carry = np.zeros((words + 1, len(lanes)), dtype=np.uint64)
        for now in range(done + max(0, done - low) // 64, ahead + min(words - 1, (ahead - 1 + high) // 64)):  # word w takes character now - w
            w, end = max(0, -((low + 63 - now) // 65), now - ahead + 1), min(words - 1, (now + high) // 65, now - done) + 1
            if w >= end:
                continue
            v, u, t, c, x = s[w:end], us[: end - w], ts[: end - w], carry[w:end], index[: end - w]
            np.add(at[now - end + 1 - done : now - w + 1 - done][::-1], row[w:end], out=x)
            flat.take(x, out=u, mode="clip")
            u &= v
            np.add(v, u, out=t)
            v ^= u
            if words > 1:
                if w == max(0, now - w - low) // 64:
                    c[0] = 0
                t += c
                c = carry[w + 1 : end + 1]
                np.invert(t, out=c)
                c &= v
                c |= u
                c >>= np.uint64(63)
            v |= t
        done = ahead
        if len(over := np.flatnonzero(m <= done)):
            have = 64 * words - np.bitwise_count(s.take(over, axis=1)).sum(axis=0, dtype=np.int64)
            found[lanes[over]] = np.where(have >= need[over], have, -1)
        if done == steps:
            break
        start, end = max(0, done - low) // grid, min(int(n.max()), done + high) // grid
        upto = min(words, ((end + 1) * grid + 63) // 64)
        ones = np.bitwise_count(s[:upto].view(f"u{bits // 8}").reshape(upto, len(lanes), 64 // bits)).transpose(0, 2, 1).reshape(-1, len(lanes))
        zeros = np.zeros((len(ones) + 1, len(lanes)), dtype=np.int32)
        np.cumsum(np.uint8(bits) - ones, axis=0, dtype=np.int32, out=zeros[1:])
        stay, todo = np.zeros(len(lanes), dtype=bool), np.flatnonzero(m > done)
        rest = right.after.take(np.minimum(first_rest + done // 32, last_rest), axis=1).astype(kind, copy=False)  # letters of the right texts' rests
        cells, after = range(start, end + 1), m - done
        edges = [zeros[min(c * grid // bits, len(ones))] for c in range(start, end + 2)]
        most = [edges[c - start] + n - c * grid for c in cells]
        may = [np.minimum(most[c - start], edges[c - start + 1] + np.minimum(n - c * grid, after)) >= need for c in cells]  # by lengths alone
        may = np.array(may, dtype=bool).reshape(len(cells), len(lanes))
        for c in sorted(cells, key=lambda c: abs(2 * (c * grid - done) + grid)):  # places from c * grid on, before the next cell
            some = todo[may[c - start, todo]]
            if not len(some):
                continue
            shared = left.after[c].take(ks[some], axis=1)
            shared = np.minimum(shared, rest if len(some) == len(lanes) else rest.take(some, axis=1), out=shared if shared.dtype == kind else None).sum(axis=0, dtype=kind)
            stay[some[np.minimum(edges[c - start + 1][some] + shared, most[c - start][some]) >= need[some]]] = True
            todo = todo[~stay[todo]]
            if not len(todo):
                break
        if len(by := start + np.flatnonzero(may[:, stay].any(axis=1))):  # what strays more later could do so here, unless it is before the first place
            low, high = min(low, max(0, done - int(by[0]) * grid)) if by[0] else low, min(high, max(0, (int(by[-1]) + 1) * grid - done))
            s[(done + high) // 64 + 1 :] = ~np.uint64(0)  # as before their first step, when the narrower band reaches them
        if np.count_nonzero(stay) < 0.9 * len(lanes) or len(over):
            s = s.compress(stay, axis=1)
            ks, lanes, n, m, need, starts, base, first_rest, last_rest = (x[stay] for x in (ks, lanes, n, m, need, starts, base, first_rest, last_rest))
    return found


def _classes(x: np.ndarray) -> np.ndarray:
    """Of characters: a number for each of the common letters, and for classes of others."""
    of = np.arange(128) % 16 + len(LETTERS)
    of[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
    return np.where(x < 128, of[np.minimum(x, 127)], x % 16 + len(LETTERS))


def _counts(texts: list[str]) -> np.ndarray:
    """A column for each text: how often it has each class of characters."""
    out = np.zeros((len(LETTERS) + 16, len(texts)), dtype=np.int32)
    for k, t in enumerate(texts):
        out[:, k] = np.bincount(_classes(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)), minlength=len(out))
    most = max(map(len, texts), default=0)
    return out.astype(np.uint8 if most < 256 else np.uint16 if most < 1 << 16 else np.int32)


def _links(left: list[tuple[int, str]], right: list[tuple[int, str]] | None, threshold: float) -> list[tuple[int, int, float]]:
    """i, j, sim of similar texts of two blocks, or within one."""
    left = sorted(left, key=lambda r: len(r[1]))
    right = left if (one := right is None) else sorted(right, key=lambda r: len(r[1]))
    lengths, counts, out = np.array([len(t) for _, t in right]), _counts([t for _, t in right]), []
    mine, chars = counts if one else _counts([t for _, t in left]), {}
    kind = max(counts.dtype, mine.dtype)
    sums = np.uint16 if len(left) and len(right) and max(len(left[-1][1]), len(right[-1][1])) < 1 << 16 else np.int32

    def of(side, k, t):
        if (side, k) not in chars:
            if len(chars) > 4000:
                chars.clear()
            chars[side, k] = Counter(t)
        return chars[side, k]

    sides = _sides([[t for _, t in x] for x in ((left,) if one else (left, right))], [counts] if one else [mine, counts])
    held, size = [], 0  # pairs of shorter texts, compared together

    def compared():
        if held:
            ks, js = (np.concatenate(x) for x in zip(*held, strict=True))
            for at, sim in _similar(sides[0], sides[-1], ks, js, threshold):
                i, j = left[ks[at]][0], right[js[at]][0]
                out.append((min(i, j), max(i, j), sim))
            held.clear()

    for k, (i, a) in enumerate(left):
        n, where = len(a), None
        # lengths a <= b can reach the threshold only if 2 a >= threshold * (a + b)
        lo = k + 1 if one else int(np.searchsorted(lengths, n * threshold / (2 - threshold) - 1e-6))
        hi = int(np.searchsorted(lengths, n * (2 - threshold) / threshold + 1e-6, side="right"))
        for at in range(lo, hi, 4096):
            end = min(hi, at + 4096)
            common = np.minimum(counts[:, at:end], mine[:, k : k + 1], dtype=kind).sum(axis=0, dtype=sums)  # no subsequence is longer
            found = at + np.flatnonzero(2.0 * common >= (threshold - 1e-9) * (n + lengths[at:end]))
            if 0 < n <= SHORT:
                short = found[lengths[found] <= SHORT]
                held.append((np.full(len(short), k), short))
                size += len(short)
                if size >= TOGETHER:
                    compared()
                    size = 0
                found = found[lengths[found] > SHORT]
            for j in found.tolist():
                b = right[j][1]
                if 2 * (of(0, k, a) & of(one ^ 1, j, b)).total() >= threshold * (n + len(b)) - 1e-6:
                    where = _places(a) if where is None else where
                    if (sim := ratio(a, b, threshold, where)) >= threshold:
                        out.append((min(i, right[j][0]), max(i, right[j][0]), sim))
    compared()
    return out


def _compressed(firsts: DataFrame) -> DataFrame:
    """first, key, n and z, the compressed text, of first, key, n, t."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                z = pa.array([zlib.compress(t.encode("utf-8"), 1) for t in part.column(3).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), z], names=["first", "key", "n", "z"])

    kind = firsts.schema["first"].dataType.simpleString()
    return firsts.select("first", "key", "n", "t").mapInArrow(run, f"first {kind}, key binary, n int, z binary")


def _compared(rows: DataFrame, threshold: float) -> DataFrame:
    """i, j, sim of texts (block, group, first, z); blocks are numbered by group, and texts of a group have partners in it and the next.

    A block becomes a row, in a partition of its own. Both sides of the product read the same columns, so that one shuffle serves both."""
    most = rows.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    blocks = rows.groupBy("block", "group").agg(F.collect_list(F.struct("first", "z")).alias("texts")).repartitionById(most + 1, "block")
    others = blocks.select(F.col("block").alias("other"), F.col("group").alias("upto"), F.col("texts").alias("others"))
    meet = blocks.join(others.hint("shuffle_replicate_nl"), (F.col("other") >= F.col("block")) & (F.col("upto") <= F.col("group") + 1))

    def texts(block):
        if not block.is_valid:
            return None
        firsts, zs = (block.values.field(c).to_pylist() for c in ("first", "z"))
        return [(first, zlib.decompress(z).decode("utf-8")) for first, z in zip(firsts, zs, strict=True)]

    def run(batches):
        for b in batches:
            for left, right in zip(b.column("texts"), b.column("others"), strict=True):
                out = _links(texts(left), texts(right), threshold)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["i", "j", "sim"])

    return meet.select("texts", F.when(F.col("other") > F.col("block"), F.col("others")).alias("others")).mapInArrow(run, "i long, j long, sim double")


def _blocks(firsts: DataFrame, cores: int) -> list[tuple[int, int, int, int]]:
    """Of each band: its group, that group's number of blocks, and the blocks before it. Small bands next to one another make a group.

    A few tasks a core, each of about as many characters; more where a block would be too large."""
    found = firsts.groupBy("band").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("z")).alias("bytes"), F.sum(F.col("n") + 1).alias("chars")).collect()  # by length
    bands = {r.band: np.array([r.rows / ROWS, r.bytes / BYTES, float(r.chars)]) for r in sorted(found)}
    chars = {k: x[2] for k, x in bands.items()}
    share = math.sqrt(sum(n * (n / 2 + chars.get(k + 1, 0.0)) for k, n in chars.items()) / (4 * cores)) if bands else 1.0
    groups: list[tuple[list[int], np.ndarray]] = []
    for k, x in bands.items():
        if groups and (groups[-1][1] + x <= (1, 1, share)).all():
            groups[-1] = ([*groups[-1][0], k], groups[-1][1] + x)
        else:
            groups.append(([k], x))
    counts = [max(1, round(x[2] / share), math.ceil(x[:2].max())) for _, x in groups]
    return [(k, g, n, end - n) for g, ((ks, _), n, end) in enumerate(zip(groups, counts, accumulate(counts), strict=True)) for k in ks]


def similar_pairs(samples: DataFrame, field: str = "instruction", threshold: float = THRESHOLD) -> DataFrame:
    """i, j, sim between first samples of different texts, and each other sample with the first of its text (sim 1).

    The pairs are found at the call and written: to read them again compares nothing anew."""
    rows = samples.select("idx", F.coalesce(F.col(field).cast("string"), F.lit("")).alias("t")).withColumn("key", F.unhex(F.sha2("t", 256)))
    firsts = rows.groupBy("t").agg(F.min("idx").alias("first")).select("first", F.unhex(F.sha2("t", 256)).alias("key"), F.length("t").alias("n"), "t")
    # lengths a <= b can reach t only if b / a <= (2 - t) / t; one band is that wide, so partners lie in bands k and k + 1
    step = math.log((2 - threshold) / threshold) + 1e-9 if threshold < 1 else 1e-9
    spark = samples.sparkSession
    firsts = written(_compressed(firsts), texts := scratch(spark, "near-texts"))
    same = rows.select("idx", "key").join(firsts.select("key", "first"), "key").where(F.col("idx") != F.col("first"))
    same = same.select(F.col("first").alias("i"), F.col("idx").alias("j"), F.lit(1.0).alias("sim"))
    firsts = firsts.withColumn("band", F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / step).cast("long"))
    blocks = spark.createDataFrame(_blocks(firsts, spark.sparkContext.defaultParallelism), "band long, group long, blocks long, before long")
    dealt = firsts.join(F.broadcast(blocks), "band").withColumn("block", (F.col("before") + F.pmod(F.xxhash64("first"), F.col("blocks"))).cast("int"))
    pairs = written(_compared(dealt.select("block", "group", "first", "z"), threshold).unionByName(same), scratch(spark, "near-pairs"))
    remove(spark, texts)
    return pairs


def near_groups(samples: DataFrame, field: str = "instruction", threshold: float = THRESHOLD) -> DataFrame:
    """The samples with `component`, the least idx of their group; null for samples without near duplicates."""
    return samples.join(components(similar_pairs(samples, field, threshold), "i", "j"), samples["idx"] == F.col("vertex"), "left").drop("vertex")


def near_remove(samples: DataFrame, field: str = "instruction", threshold: float = THRESHOLD, keep: str = "first") -> DataFrame:
    """One sample of each group: the first, the last or the best by quality (null as 0, ties to the first)."""
    if keep not in ("first", "last", "best"):
        raise ValueError(f"unknown keep {keep!r}")
    g = near_groups(samples, field, threshold)
    if keep == "best":
        pick = F.struct(F.coalesce("quality_score", F.lit(0.0)), -F.col("idx"))
    else:
        pick = F.struct(-F.col("idx") if keep == "first" else F.col("idx"))
    best = g.where("component is not null").groupBy("component").agg(F.max_by("idx", pick).alias("__stays"))
    out = g.join(best, "component", "left")
    return out.where(F.col("component").isNull() | (F.col("idx") == F.col("__stays"))).select(*samples.columns)


def stats(samples: DataFrame, field: str = "instruction", threshold: float = THRESHOLD) -> DataFrame:
    """total, exact duplicates, near-duplicate pairs (copies counted pairwise), unique."""
    rows = samples.select("idx", F.sha2(F.coalesce(F.col(field).cast("string"), F.lit("")), 256).alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("k"))
    pairs = similar_pairs(samples, field, threshold).where("sim < 1")
    of = rows.join(sizes, "key").select("idx", "k")
    between = pairs.join(of.select(F.col("idx").alias("i"), F.col("k").alias("ki")), "i").join(of.select(F.col("idx").alias("j"), F.col("k").alias("kj")), "j")
    n = between.agg(F.coalesce(F.sum(F.col("ki") * F.col("kj")), F.lit(0)).alias("between"))
    counts = sizes.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("exact_duplicates"),
        F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2).cast("long"), F.lit(0)).alias("within"),
    )
    return counts.crossJoin(n).select(  # one row each
        "total", "exact_duplicates", (F.col("within") + F.col("between")).alias("near_duplicate_pairs"), (F.col("total") - F.col("exact_duplicates")).alias("unique")
    )
