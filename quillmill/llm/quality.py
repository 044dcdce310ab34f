"""Operator 6: quality classification by co-training of a text view and a metadata view.

The text view reads the whole text: the log-odds of its hashed words and pairs of neighbouring words (`TERMS` buckets, case
kept), and measures of it (shape of words, repetition, case, symbols, lines). The metadata view sees source, language, both
together, and the recorded length. Each is an additive logistic model over bins; the words' log-odds enter the text view as
one more binned column, for training rows from the half of the rows that their text isn't in, so that rare words of a row
don't vouch for its own label. Both views start from the same labelled rows; over `ROUNDS` rounds each scores all
unlabelled rows and hands those it is surest of (`SURE` and more, calibrated), in the proportion of the labels and up to
`SHARE` of the unlabelled rows, to the other as pseudo-labels. Each view is calibrated on labelled rows that took no part
in training; in the end the sum of both log-odds, less the prior's, calibrated on the same rows, scores every document.

Only the labelled rows are a bounded sample, the `SAMPLE` of least hash of the id, whose features reach the driver. Bin edges
are quantiles over all documents (to a part in 2^10, from counts that don't depend on partitions). Unlabelled rows stay
distributed, as numbers of bins and buckets: a round counts them by log-odds for the bounds above which rows are handed over
(rows at a bound by hash of the id), and writes the rows handed over apart from those left; counts of words and every Newton
step are sums over the rows handed over so far. Scoring is one pass without shuffles; the model that tasks get has some
twenty thousand numbers.

Defined cases: null and empty texts have no words and all measures zero; null metadata values are a value of their own;
unlabelled rows and null labels don't train; a metadata view that tells nothing stays at the base rate and changes nothing;
with no labelled row, or one class only, every document gets the base rate (1, accepted, with no row at all); an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE = 12_000
ROUNDS = 4
SURE = 0.95
SHARE = 0.05
BINS = 16
TERMS = 1 << 13
SMOOTH = 4.0
PENALTY = 1.0
MEASURES = 15
#: Buckets of source, language, and both.
HASHED = (128, 32, 128)
#: Edges of the bins of the words' log-odds, and of Newton's and the bounds' log-odds the sharpness.
GRID = np.arange(-4, 4.01, 0.25)
SHARP = 256
#: Bytes of a text that are hashed at a time.
CHUNK = 1 << 18
#: Labelled ids up to this number are broadcast, as 16 bytes each.
BROADCAST_IDS = 500_000
#: Tasks that add up sums before they reach the driver.
FEW, MANY = 4, 16

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


LOWER, UPPER, DIGIT, ODD, BAR, CALL, STOP, ASK, HALF = range(1, 10)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each UTF-16 unit."""

    def kind(c: str) -> int:
        if c.isalpha():
            return UPPER if c.isupper() else LOWER
        if "0" <= c <= "9":
            return DIGIT
        if c in "|!.?":
            return {"|": BAR, "!": CALL, ".": STOP, "?": ASK}[c]
        return 0 if c.isalnum() or c.isspace() or c in "_,;:'\"()-" else ODD

    return np.array([HALF if 0xD800 <= k < 0xE000 else kind(chr(k)) for k in range(1 << 16)], dtype=np.uint8)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    out = []
    for base in (int(_A), pow(int(_A), -1, 1 << 64)):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return tuple(out)


SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_space = re.compile(rb"[ \t-\r]").search


def _words(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word: the sum of its bytes times powers, from the whole text's prefix sums."""
    out, at = [np.empty(0, dtype=np.uint64)], 0
    while at < len(data):
        cut = _space(data, at + CHUNK)  # a chunk ends at white space
        end = cut.start() if cut else len(data)
        x = np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)
        inside = np.concatenate([[False], ~SPACE[x], [False]])
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        power, back = _powers(1 << max(16, (end - at).bit_length()))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((x.astype(np.uint64) + _B) * power[: len(x)])])
        out.append((sums[ends] - sums[starts]) * back[starts])
        at = end
    return np.concatenate(out)


def _once(x: np.ndarray) -> tuple[np.ndarray, int]:
    """The distinct values of a non-empty array, and how often the commonest comes."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[first], int((np.concatenate([first[1:], [len(x)]]) - first).max())


def features(text: str | None) -> tuple[list[float], np.ndarray]:
    """Measures of the whole text, and the distinct buckets of its words and pairs of neighbouring words.

    Words part at ASCII white space."""
    text = text or ""
    h = _words(text.encode("utf-8", "surrogatepass"))
    if not len(h):
        return [0.0] * MEASURES, np.empty(0, dtype=np.uint16)
    n, chars = len(h), len(text)
    own, times = _once(h)
    pairs = _once((h[:-1] * _A + h[1:]) * _B)[0] if n > 1 else h[:0]
    turns = np.concatenate([[-1], np.flatnonzero(h[1:] != h[:-1]), [n - 1]])
    longest = int((turns[1:] - turns[:-1]).max())
    c = np.bincount(_kinds()[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")], minlength=10)
    letters, upper, odd = c[LOWER] + c[UPPER], c[UPPER], c[ODD] + c[BAR] + c[CALL] + c[ASK]
    if c[HALF]:  # characters of two units
        for x in text:
            if x > "￿":
                letters, upper, odd = letters + x.isalpha(), upper + x.isupper(), odd + (not x.isalnum() and not x.isspace())
    lines = text.split("\n")
    found = [
        np.log1p(n),
        len(own) / n**0.9,
        times / n,
        longest / n,
        longest,
        len(pairs) / n,
        upper / max(1, letters),
        odd / chars,
        odd / n,
        c[BAR] / n,
        c[CALL] / n,
        c[DIGIT] / chars,
        letters / n,
        len(set(lines)) / len(lines),
        (c[CALL] + c[STOP] + c[ASK]) / n,
    ]
    return found, _once((np.concatenate([own * _B, pairs]) >> np.uint64(64 - 13)).astype(np.uint16))[0]


def metadata(source: str | None, lang: str | None, n_chars) -> list[float]:
    def hashed(x, n):
        return 0 if x is None else 1 + zlib.crc32(str(x).encode("utf-8")) % (n - 1)

    both = None if source is None and lang is None else f"{source}\n{lang}"
    return [*map(hashed, (source, lang, both), HASHED), -1.0 if n_chars is None else float(np.log1p(max(0, n_chars)))]


class Bins:
    """Columns binned at edges, the bins of all columns numbered through."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges = edges
        self.starts = np.cumsum([0, *[len(e) + 1 for e in edges]])
        self.size = int(self.starts[-1]) + 1  # and a constant

    def cells(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        """Of the columns from the given one on."""
        return np.stack([np.searchsorted(self.edges[first + j], x[:, j], side="right") + self.starts[first + j] for j in range(x.shape[1])], axis=1)


def _packed(terms: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Ascending buckets as their numbers by page of 256, and their last bytes: half the size."""
    pages = (np.bincount(t >> 8, minlength=TERMS >> 8).astype(np.uint16).tobytes() for t in terms)
    return pa.array(pages, pa.binary()), pa.array((t.astype(np.uint8).tobytes() for t in terms), pa.binary())


def _unpacked(pages: bytes, last: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all rows, and the ends of each row's."""
    n = np.frombuffer(pages, dtype=np.uint16).reshape(-1, TERMS >> 8)
    page = np.repeat(np.tile(np.arange(TERMS >> 8, dtype=np.uint16), len(n)), n.ravel())
    return (page << 8) + np.frombuffer(last, dtype=np.uint8), np.cumsum(n.sum(axis=1, dtype=np.int64))


class Rows:
    """Some rows' features: key (hash of the id), half (of the text), cells of measures and metadata, buckets of words."""

    def __init__(self, key, half, text, meta, terms: np.ndarray, ends: np.ndarray):
        self.key, self.half, self.text, self.meta, self.terms, self.ends = key, half, text, meta, terms, ends

    @classmethod
    def of(cls, b: pa.RecordBatch) -> Rows:
        """Of a batch of the columns of `POOL`."""
        n, bytes_of = b.num_rows, lambda j: b"".join(b.column(j).to_pylist())
        cells = (np.frombuffer(bytes_of(j), dtype=np.int16).reshape(n, k).astype(np.int64) for j, k in ((2, MEASURES), (3, len(HASHED) + 1)))
        return cls(b.column(0).to_numpy(), b.column(1).to_numpy(), *cells, *_unpacked(bytes_of(4), bytes_of(5)))

    def __len__(self):
        return len(self.key)

    def take(self, on: np.ndarray) -> Rows:
        sizes = np.diff(self.ends, prepend=0)
        return Rows(self.key[on], self.half[on], self.text[on], self.meta[on], self.terms[np.repeat(on, sizes)], np.cumsum(sizes[on]))

    def parts(self, n: int = 1024) -> Iterator[Rows]:
        for at in range(0, len(self), n):
            first = int(self.ends[at - 1]) if at else 0
            ends = self.ends[at : at + n]
            yield Rows(self.key[at : at + n], self.half[at : at + n], self.text[at : at + n], self.meta[at : at + n], self.terms[first : int(ends[-1])], ends - first)


class Views:
    """Both views: log-odds of words by half of the rows (odds[h]: from the rows not in half h), weights of bins."""

    def __init__(self, bins: tuple[Bins, Bins]):
        self.bins = bins
        self.odds = np.zeros((2, TERMS))
        self.weights = [np.zeros(b.size) for b in bins]

    def cells(self, rows: Rows, apart: bool) -> tuple[np.ndarray, np.ndarray]:
        """apart: rows took part in training, so the log-odds of their words come from the other half."""
        said, mean = [np.empty(0)], self.odds.mean(axis=0)
        for part in rows.parts():
            sizes = np.diff(part.ends, prepend=0)
            each = self.odds[np.repeat(part.half, sizes), part.terms] if apart else mean[part.terms]
            sums = np.concatenate([[0.0], np.cumsum(each)])
            said.append((sums[part.ends] - sums[part.ends - sizes]) / np.sqrt(np.maximum(sizes, 1)))
        return np.column_stack([rows.text, self.bins[0].cells(np.concatenate(said)[:, None], MEASURES)]), rows.meta

    def raw(self, rows: Rows) -> list[np.ndarray]:
        return [np.clip(w[c].sum(axis=1) + w[-1], -12, 12) for w, c in zip(self.weights, self.cells(rows, False), strict=True)]

    def calibrate(self, rows: Rows, y: np.ndarray) -> None:
        self.scale = [_calibrated(z, y) for z in self.raw(rows)]

    def logits(self, rows: Rows) -> list[np.ndarray]:
        """Calibrated log-odds by the text and by the metadata."""
        return [z * slope + offset for z, (slope, offset) in zip(self.raw(rows), self.scale, strict=True)]


def _sums(cells: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Curvature and, as the last row, gradient of the likelihood, added over rows."""
    d, out = len(w), np.zeros((len(w) + 1, len(w)))
    cells = np.column_stack([cells, np.full(len(cells), d - 1)])
    for at in range(0, len(cells), 2048):
        c, part = cells[at : at + 2048], y[at : at + 2048]
        p = _sigmoid(w[c].sum(axis=1))
        k = c.shape[1]
        out[:-1] += np.bincount((c[:, :, None] * d + c[:, None, :]).ravel(), np.repeat(p * (1 - p), k * k), d * d).reshape(d, d)
        out[-1] += np.bincount(c.ravel(), np.repeat(part - p, k), d)
    return out


def _bin(side: np.ndarray) -> np.ndarray:
    """Bins of log-odds of `SURE` or more; -1 below."""
    return np.where(side >= np.log(SURE / (1 - SURE)), np.minimum(side, 30) * SHARP, -1).astype(np.int64)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic model of z, pulled to 1 and 0 where rows are few; never a falling one."""
    m, mean = np.column_stack([z, np.ones(len(z))]), np.array([1.0, 0.0])
    w = mean.copy()
    for _ in range(25):
        p = _sigmoid(m @ w)
        h = (m * (p * (1 - p))[:, None]).T @ m + 2 * np.eye(2)
        w = w + np.linalg.solve(h, m.T @ (y - p) - 2 * (w - mean))
    if w[0] > 0:
        return float(w[0]), float(w[1])
    rate = (y.sum() + 1) / (len(y) + 2)
    return 0.0, float(np.log(rate / (1 - rate)))


class Model:
    """Calibrated views, the prior's log-odds and the calibration of the views' sum; or a constant probability."""

    def __init__(self, constant: float | None = None, views: Views | None = None, prior: float = 0.0):
        self.constant, self.views, self.prior, self.scale = constant, views, prior, (1.0, 0.0)

    def both(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.views.logits(rows)
        return a, b, a + b - self.prior

    def scores(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities by the text, by the metadata, and by both."""
        a, b, z = self.both(rows)
        return _sigmoid(a), _sigmoid(b), _sigmoid(z * self.scale[0] + self.scale[1])


def _added(rows: DataFrame, shape: tuple[int, ...], of, deep: bool = False) -> np.ndarray:
    """The sum over all batches of what `of` gives, an array of the shape. `FEW` tasks, or `MANY` if deep, add up those of all
    others first, so that what reaches the driver doesn't grow with the partitions."""

    def sums(read):
        def run(batches):
            total = np.zeros(shape)
            for b in batches:
                total += read(b)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        return run

    def again(b):
        return sum((np.frombuffer(x).reshape(shape) for x in sorted(b.column(0).to_pylist())), np.zeros(shape))  # in one order

    got, out = rows.mapInArrow(sums(of), "total binary"), np.zeros(shape)
    got = got.repartition(MANY if deep else FEW).mapInArrow(sums(again), "total binary")
    for r in got.collect():
        out += np.frombuffer(r[0]).reshape(shape)
    return out


def _word_counts(rows: Rows, y: np.ndarray) -> np.ndarray:
    """By half and label: rows with each bucket and, last, rows."""
    out, kind = np.zeros((4, TERMS + 1)), rows.half * 2 + y.astype(np.int64)
    for at, part in enumerate(rows.parts()):
        k = kind[at * 1024 : at * 1024 + 1024]
        out[:, :-1] += np.bincount(np.repeat(k, np.diff(part.ends, prepend=0)) * TERMS + part.terms, minlength=4 * TERMS).reshape(4, TERMS)
        out[:, -1] += np.bincount(k, minlength=4)
    return out.reshape(2, 2, -1)


def _fit(views: Views, own: Rows, y: np.ndarray, handed: DataFrame | None, deep: bool = False) -> None:
    """Fits on labelled rows and on rows handed over (columns of `Rows`, then the labels given to text and metadata)."""

    def to_text(b):
        marks = b.column(6).to_numpy()
        return Rows.of(b.filter(pa.array(marks >= 0))), marks[marks >= 0].astype(np.float64)

    def to_meta(b):
        marks = b.column(7).to_numpy()
        cells = b.column(3).filter(pa.array(marks >= 0)).to_pylist()
        return np.frombuffer(b"".join(cells), dtype=np.int16).reshape(len(cells), len(HASHED) + 1).astype(np.int64), marks[marks >= 0].astype(np.float64)

    counts = _word_counts(own, y)
    if handed is not None:
        counts += _added(handed, counts.shape, lambda b: _word_counts(*to_text(b)), deep)
    for h in (0, 1):
        c = counts[1 - h]
        rate = np.clip(c[1, -1] / max(1.0, c[:, -1].sum()), 1e-3, 1 - 1e-3)
        views.odds[h] = np.log((c[1, :-1] + SMOOTH * rate) / (c[0, :-1] + SMOOTH * (1 - rate))) - np.log(rate / (1 - rate))
    cells, sizes, todo = views.cells(own, True), [b.size for b in views.bins], [0, 1]
    upper = [tuple(np.concatenate([x, e]) for x, e in zip(np.triu_indices(d), (np.full(d, d), np.arange(d)), strict=True)) for d in sizes]
    views.weights = [np.zeros(d) for d in sizes]  # from nought, since steps from weights that are sure of their rows overshoot
    for _ in range(12):
        total = [_sums(cells[v], y, views.weights[v]) for v in (0, 1)]
        if handed is not None:

            def of(b, views=views, todo=tuple(todo)):
                out = []
                for v in todo:
                    rows, marks = to_text(b) if v == 0 else to_meta(b)
                    out.append(_sums(rows if v else views.cells(rows, True)[0], marks, views.weights[v])[upper[v]])
                return np.concatenate(out)

            got, at = _added(handed, (sum(len(upper[v][0]) for v in todo),), of, deep), 0
            for v in todo:  # a curvature is sent as its upper half
                d, n = sizes[v], len(upper[v][0])
                whole = np.zeros((d + 1, d))
                whole[upper[v]] = got[at : at + n]
                whole[:-1] += np.triu(whole[:-1], 1).T
                total[v], at = total[v] + whole, at + n
        for v in list(todo):
            ridge = np.full(sizes[v], PENALTY)
            ridge[-1] = 1e-3
            step = np.linalg.solve(total[v][:-1] + np.diag(ridge), total[v][-1] - ridge * views.weights[v])
            views.weights[v] = views.weights[v] + step
            if np.abs(step).max() < 1e-2:
                todo.remove(v)
        if not todo:
            break


def _bounds(pool: DataFrame, views: Views, quota: list[int], deep: bool = False) -> list[list[tuple[int, float]]]:
    """By view and label: the bin from which rows are handed over, and the share of that bin's rows."""
    width = 30 * SHARP + 1

    def of(b):
        out = np.zeros((2, 2, width))
        for v, z in enumerate(views.logits(Rows.of(b))):
            for label, side in ((1, z), (0, -z)):
                k = _bin(side)
                out[v, label] += np.bincount(k[k >= 0], minlength=width)
        return out

    counts, out = _added(pool, (2, 2, width), of, deep), [[], []]
    for v in (0, 1):
        for label in (0, 1):
            above = np.cumsum(counts[v, label][::-1])[::-1]  # rows in the bin or above
            full = np.flatnonzero(above >= quota[label])
            if not len(full):  # fewer rows than that are sure
                out[v].append((-1, 0.0))
            else:
                n = counts[v, label][full[-1]]
                out[v].append((int(full[-1]), float((quota[label] - above[full[-1]] + n) / n) if n else 0.0))
    return out


POOL = "key long, half int, text binary, meta binary, pages binary, last binary"


def _hand_over(pool: DataFrame, views: Views, bounds: list[list[tuple[int, float]]], folder: str) -> tuple[DataFrame, DataFrame]:
    """The rows left, and those handed over with the labels given to text and metadata (-1: none), written apart."""

    def run(batches):
        for b in batches:
            rows = Rows.of(b)
            given = np.full((2, len(rows)), -1, dtype=np.int32)
            part = (rows.key.view(np.uint64) * _A >> np.uint64(44)).astype(np.float64) / (1 << 20)
            for v, z in enumerate(views.logits(rows)):
                for label, side in ((1, z), (0, -z)):
                    bound, share = bounds[v][label]
                    k = _bin(side)
                    given[1 - v, (k >= 0) & ((k > bound) | ((k == bound) & (part < share)))] = label
            gone = pa.array((given >= 0).any(axis=0), pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(g) for g in given), gone], names=[*b.schema.names, "to_text", "to_meta", "gone"])

    schema = f"{POOL}, to_text int, to_meta int, gone boolean"
    pool.mapInArrow(run, schema).write.partitionBy("gone").parquet(folder)
    back = pool.sparkSession.read.schema(schema).parquet(folder)
    return back.where("not gone").drop("gone", "to_text", "to_meta"), back.where("gone").drop("gone")


def co_train(own: Rows, y: np.ndarray, held: np.ndarray, bins: tuple[Bins, Bins], of_pool: str, rounds: int = ROUNDS) -> Model:
    """own, y: labelled rows; held: those kept for calibration; of_pool: folder of the unlabelled rows, which is used up."""
    spark = SparkSession.getActiveSession()
    pool = spark.read.schema(POOL).parquet(of_pool)
    n = pool.count()
    if min(len(set(y[held].tolist())), len(set(y[~held].tolist()))) < 2:
        held = np.zeros(len(y), dtype=bool)
    views, handed, folders = Views(bins), None, []
    rate, parts = float(y.mean()), pool.rdd.getNumPartitions() if n else 0
    deep = parts > 256
    quota = [int(n * SHARE * share) for share in (1 - rate, rate)]
    learn, check = own.take(~held), own.take(held) if held.any() else own
    y_learn, y_check = y[~held], y[held] if held.any() else y
    _fit(views, learn, y_learn, None)
    views.calibrate(check, y_check)
    for _ in range(rounds if n else 0):
        folders.append(common.scratch(spark, "quality-round"))
        pool, new = _hand_over(pool, views, _bounds(pool, views, quota, deep), folders[-1])
        common.remove(spark, f"{folders[-2]}/gone=false" if len(folders) > 1 else of_pool)
        handed = (new if handed is None else handed.unionByName(new)).coalesce(max(8, parts // 8))
        _fit(views, learn, y_learn, handed, deep)
        views.calibrate(check, y_check)
    for f in folders:
        common.remove(spark, f)
    out = Model(views=views, prior=float(np.log(rate / (1 - rate))))
    out.scale = _calibrated(out.both(check)[2], y_check)
    return out


def _quantiles(rows: DataFrame) -> list[np.ndarray]:
    """Edges of `BINS` bins of each number in `found`, over all rows; a value of an edge's own grain lies above the edge."""
    width = MEASURES + len(HASHED) + 1

    def run(batches):
        total = [Counter() for _ in range(width)]
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
            for j, t in enumerate(total):
                grain = np.abs(x[:, j]).view(np.int64) >> 42
                k, n = np.unique(np.where(x[:, j] < 0, -1 - grain, grain), return_counts=True)
                t.update(dict(zip(k.tolist(), n.tolist(), strict=True)))
        for j, t in enumerate(total):
            yield pa.RecordBatch.from_arrays([pa.array([j] * len(t), pa.int32()), pa.array(list(t), pa.int64()), pa.array(list(t.values()), pa.int64())], names=["j", "grain", "n"])

    got, out = rows.select("found").mapInArrow(run, "j int, grain long, n long").groupBy("j", "grain").agg(F.sum("n")).collect(), []
    for j in range(width):
        k, n = np.array(sorted((r[1], r[2]) for r in got if r[0] == j), dtype=np.int64).reshape(-1, 2).T
        upto = np.cumsum(n)
        at = k[np.searchsorted(upto, (upto[-1] - 1) * np.arange(1, BINS) / BINS, side="right")] if len(k) else k
        edge = (np.where(at < 0, -at, at) << 42).view(np.float64)
        out.append(np.unique(np.where(at < 0, -edge, edge)))
    return out


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), "source", "lang", F.col("n_chars").cast("double").alias("n_chars"))


def _measured(part: pa.RecordBatch, names: dict[str, int]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Measures, metadata and buckets of a batch."""
    text, source, lang, n = (part.column(names[c]).to_pylist() for c in ("text", "source", "lang", "n_chars"))
    found = list(map(features, text))
    x = np.array([m for m, _ in found], dtype=np.float64).reshape(len(text), MEASURES)
    z = np.array([metadata(*m) for m in zip(source, lang, n, strict=True)], dtype=np.float64).reshape(len(text), len(HASHED) + 1)
    return x, z, [t for _, t in found]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    n = known.count()
    labelled, marked = F.broadcast(common.few(known, sample)), known.where("id is not null").select("id").distinct()
    marked = F.broadcast(marked) if n <= BROADCAST_IDS else marked
    rows = _inputs(docs, id_col, text_col).withColumn("half", F.pmod(F.xxhash64("text"), F.lit(8)).cast("int"))
    names = {"text": 1, "source": 2, "lang": 3, "n_chars": 4}

    def measured(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x, z, terms = _measured(part, names)
                found = pa.array(list(np.column_stack([x, z])), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), found, *_packed(terms), part.column(5)], names=["id", "found", "pages", "last", "half"])

    kind = rows.schema["id"].dataType.simpleString()
    all_ = common.written(rows.mapInArrow(measured, f"id {kind}, found array<double>, pages binary, last binary, half int"), folder := common.scratch(spark, "quality-measures"))
    got = all_.join(labelled, "id").select(F.xxhash64("id").alias("key"), F.col("label").cast("double"), "half", "found", "pages", "last")
    got = got.orderBy("key", "label", "half", "pages", "last").limit(sample) if got.select("key").count() > sample else got  # ids repeat
    got = got.toArrow().sort_by([("key", "ascending"), ("label", "ascending")])
    key, y, half = (got.column(j).to_numpy() for j in range(3))
    if not len(y) or y.min() == y.max():
        common.remove(spark, folder)
        return Model(float(y[0]) if len(y) else 1.0)
    edges = _quantiles(all_)
    bins = Bins([*edges[:MEASURES], GRID]), Bins([*(np.arange(h - 1) + 0.5 for h in HASHED), edges[-1]])
    xz = got.column(3).combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    terms = _unpacked(*(b"".join(got.column(j).to_pylist()) for j in (4, 5)))
    own = Rows(key, half & 1, bins[0].cells(xz[:, :MEASURES]), bins[1].cells(xz[:, MEASURES:]), *terms)

    def binned(batches):
        for b in batches:
            x = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
            cells = [c.cells(part).astype(np.int16) for c, part in zip(bins, (x[:, :MEASURES], x[:, MEASURES:]), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([c.tobytes() for c in m], pa.binary()) for m in cells), b.column(3), b.column(4)], names=["key", "half", "text", "meta", "pages", "last"])

    # null ids have no label; they pass beside the join, as it would take them to one task
    unlabelled = all_.where("id is not null").join(marked, "id", "left_anti").unionByName(all_.where("id is null")).select(F.xxhash64("id").alias("key"), F.col("half").bitwiseAND(1).alias("half"), "found", "pages", "last")
    unlabelled.mapInArrow(binned, POOL).write.parquet(cells := common.scratch(spark, "quality-cells"))
    common.remove(spark, folder)
    # texts, not ids, part training from calibration and the halves, so that copies of a text lie on one side
    model = co_train(own, y, half >> 1 == 0, bins, cells, rounds)
    common.remove(spark, cells)
    del got, xz, terms, own
    pa.default_memory_pool().release_unused()  # the driver's, before other steps
    return model


def _scores(model: Model, part: pa.RecordBatch, names: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if model.constant is not None:
        return (np.full(part.num_rows, model.constant),) * 3
    none, bins, (x, z, terms) = np.zeros(part.num_rows, dtype=np.int64), model.views.bins, _measured(part, names)
    flat = np.concatenate([np.empty(0, dtype=np.uint16), *terms])
    return model.scores(Rows(none, none, bins[0].cells(x), bins[1].cells(z), flat, np.cumsum([len(t) for t in terms], dtype=np.int64)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_score, meta_score, score."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = {"text": 1, "source": 2, "lang": 3, "n_chars": 4}

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(s, pa.float64()) for s in _scores(model, part, names))], names=["doc_id", "text_score", "meta_score", "score"])

    return _inputs(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, text_score double, meta_score double, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of docs with a score of the limit or more, all columns, in one pass."""
    names = {"text": docs.columns.index(text_col)} | {c: docs.columns.index(c) for c in ("source", "lang", "n_chars")}

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                yield part.filter(pa.array(_scores(model, part, names)[2] >= limit, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return out.withColumn("accepted", F.col("score") >= 0.5)
