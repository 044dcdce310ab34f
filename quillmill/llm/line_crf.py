"""Operator 13: quality rules, and a linear-chain conditional random field that labels a text's lines.

The lines with words of a text are a chain of two labels, content and boilerplate. A line scores by the bins of what is
counted on it (`features`: words, symbols, capitals, digits, repeated words, first and last character, place), the chain
by its transitions; Viterbi decoding gives the best labelling of the whole text, and a text stays if at least `SHARE` of its words lie
in content lines, and the rules hold.

The field learns from documents, as there are no labelled lines: lines of good documents count as content. Those of poor
ones count as boilerplate at first; then, in `ROUNDS` more fits, only those that the field decodes so, and of the others the least likely content until
half of the words are boilerplate. It is fitted by full gradients of the exact likelihood (forward and backward sums) on
the driver, on a bounded sample: at most `SAMPLE` labelled rows, those of least hash, with at most `LINES` lines each; longer
ones don't train. Only numbers of bins reach the driver. Labelling is one pass without shuffles over whole texts.

Defined cases: null and empty texts have no words, fail the rules and are not kept; blank lines have no label; with no
labelled row, or of one class only, the field isn't fitted and the rules alone decide; several labels of an identifier
each count; a null identifier is passed on and never labelled; repeated rows are each labelled; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The rules' limits.
MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"

SAMPLE = 6_000
LINES = 2_000
ROUNDS = 2
STEPS = 80
RATE = 0.1
PENALTY = 2.0
SHARE = 0.5

#: Classes of characters: space (ASCII), symbol, exclamation or question, capital, small, other letter, digit, full stop, other mark.
SPACE, SYMBOL, CRY, CAPITAL, SMALL, LETTER, DIGIT, STOP, OTHER = range(9)
#: Upper bounds of the bins of each number measured on a line.
BINS = [
    np.array([1, 2, 4, 7, 12, 20, 33, 54]),  # words
    np.array([0, 0.01, 0.03, 0.06, 0.1, 0.15]),  # symbols to characters
    np.array([0, 0.01, 0.03, 0.06, 0.1]),  # exclamations
    np.array([0, 0.02, 0.06, 0.12, 0.25, 0.5]),  # capitals to letters
    np.array([0, 0.02, 0.1, 0.25]),  # digits to characters
    np.array([0.3, 0.5, 0.65, 0.8, 0.9]),  # distinct words to words, from 8 words on
    np.array([2, 3, 4, 5, 6, 8, 11]),  # letters and digits to words
    np.array([0, 0.1, 0.3]),  # words like the one before
    np.array([0, 0.02, 0.05, 0.1, 0.2]),  # other marks to characters
]
#: After these: class of the first and of the last character, copy of an earlier line, place (only, first, last, between).
CHOICES = [9, 9, 2, 4]
OFFSETS = np.cumsum([0, *[len(b) + 1 for b in BINS], *CHOICES])
WIDTH = len(OFFSETS) - 1


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point, as a table that a worker makes once."""
    of = np.full(0x110000, OTHER, dtype=np.uint8)
    for k in range(0x20000):  # later planes: ideographs and pictures
        kind = unicodedata.category(chr(k))
        of[k] = {"Lu": CAPITAL, "Lt": CAPITAL, "Ll": SMALL, "Lm": LETTER, "Lo": LETTER, "Mn": LETTER, "Mc": LETTER, "Nd": DIGIT}.get(kind, OTHER)
    of[0x20000:0x40000] = LETTER
    of[[32, *range(9, 14)]] = SPACE
    of[[ord(c) for c in SYMBOLS + "@^~_=+{}\\/"]] = SYMBOL
    of[[ord(c) for c in "!?"]] = CRY
    of[ord(".")] = STOP
    return of


@dataclass
class Measured:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    words: np.ndarray  # of each line with words
    bins: np.ndarray  # a row of WIDTH numbers for each of these lines

    @property
    def failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEATED * self.n_words


def repeated(ids: np.ndarray) -> int:
    """Words that lie in windows of `WINDOW` words found twice or more."""
    number = common.window_numbers(ids, WINDOW)
    if not len(number):
        return 0
    at = np.flatnonzero(np.bincount(number)[number] > 1)
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(cover)))


def measure(text: str | None) -> Measured:
    text = text or ""
    lines = text.split("\n")
    split = [common.words(line) for line in lines]
    flat = [w for ws in split for w in ws]
    n, ids = np.array([len(ws) for ws in split]), common.interned(flat)
    code = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    kind, line = _classes()[code], np.cumsum(code == 10) - (code == 10)
    count = np.bincount(line * 9 + kind, minlength=9 * len(lines)).reshape(-1, 9)[: len(lines)]
    seen: set[str] = set()
    copy = np.array([k > 0 and (x in seen or seen.add(x) is not None) for k, x in zip(n.tolist(), lines, strict=True)], dtype=np.int64)
    full = np.flatnonzero(n > 0)
    chars = count.sum(axis=1) - count[:, SPACE]
    symbols = int(np.isin(code, [ord(c) for c in SYMBOLS]).sum())
    out = Measured(len(flat), int(chars.sum()), symbols, int(copy.sum()), repeated(ids), n[full], np.empty((0, WIDTH), dtype=np.int16))
    if not len(full):
        return out
    start = np.concatenate([[0], np.cumsum(n)])[:-1]
    like = np.concatenate([[0], ids[1:] == ids[:-1]])
    like[start[full]] = 0
    of = np.repeat(np.arange(len(lines)), n)
    again = np.bincount(of, weights=like, minlength=len(lines))
    distinct = np.bincount(np.unique(of * (len(flat) + 1) + ids) // (len(flat) + 1), minlength=len(lines))
    c, n, chars = count[full], n[full], np.maximum(chars[full], 1)
    letters = c[:, CAPITAL] + c[:, SMALL] + c[:, LETTER]
    found = [
        n, c[:, SYMBOL] / chars, c[:, CRY] / chars, c[:, CAPITAL] / np.maximum(letters, 1), c[:, DIGIT] / chars, np.where(n < 8, 1.0, distinct[full] / n),
        (letters + c[:, DIGIT]) / n, again[full] / n, c[:, OTHER] / chars,
    ]
    place = np.full(len(full), 3)
    place[-1], place[0] = 2, 1
    if len(full) == 1:
        place[0] = 0
    black = np.flatnonzero(kind != SPACE)
    first = np.searchsorted(line[black], full)
    last = np.searchsorted(line[black], full, side="right") - 1
    chosen = [kind[black[first]], kind[black[last]], copy[full], place]
    out.bins = np.column_stack([*(np.searchsorted(b, x) for b, x in zip(BINS, found, strict=True)), *chosen]).astype(np.int16) + OFFSETS[:-1].astype(np.int16)
    return out


@dataclass
class Field:
    """weights: of each bin, for content; moves[a][b]: of label b after label a (0 boilerplate, 1 content)."""

    weights: np.ndarray
    moves: np.ndarray

    def decode(self, bins: np.ndarray) -> np.ndarray:
        """The best labelling of a chain, ties to content."""
        (aa, ab), (ba, bb) = self.moves.tolist()
        lo, hi, back = 0.0, 0.0, []
        for k, e in enumerate(self.weights[bins].sum(axis=1).tolist()):
            if k:
                from_lo, from_hi = lo + aa > hi + ba, lo + ab > hi + bb
                lo, hi = (lo + aa if from_lo else hi + ba), (lo + ab if from_hi else hi + bb)
                back.append((from_lo, from_hi))
            hi += e
        out = np.empty(len(back) + 1, dtype=bool)
        out[-1] = at = hi >= lo
        for k in range(len(back) - 1, -1, -1):
            out[k] = at = not back[k][at]
        return out


def _sums(field: Field, bins: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of content of each line and expected moves of each chain; bins: chains by lines by WIDTH, padded."""
    e = field.weights[bins].sum(axis=2)
    chains, n = e.shape
    score = np.stack([np.zeros_like(e), e], axis=2)
    ahead, behind = np.zeros((n, chains, 2)), np.zeros((n, chains, 2))
    ahead[0] = score[:, 0]
    for t in range(1, n):
        x = ahead[t - 1][:, :, None] + field.moves[None]
        ahead[t] = np.logaddexp(x[:, 0], x[:, 1]) + score[:, t]
    for t in range(n - 2, -1, -1):
        x = field.moves[None] + (score[:, t + 1] + behind[t + 1])[:, None, :]
        behind[t] = np.where((t + 1 < size)[:, None], np.logaddexp(x[:, :, 0], x[:, :, 1]), 0.0)
    whole = np.logaddexp(*(ahead + behind)[0].T)
    content = np.exp(ahead + behind - whole[None, :, None])[:, :, 1].T
    inside = np.arange(n)[None, :] < size[:, None]
    moves = np.zeros((2, 2))
    if n > 1:
        x = ahead[:-1, :, :, None] + field.moves[None, None] + (score.transpose(1, 0, 2)[1:] + behind[1:])[:, :, None, :] - whole[None, :, None, None]
        moves = (np.exp(np.where(inside.T[1:, :, None, None], x, -np.inf))).sum(axis=(0, 1))
    return content * inside, moves


def _padded(chains: list[np.ndarray], most: int = 1 << 15) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chains of like length together: their numbers, bins and sizes."""
    order, out, at = np.argsort([len(c) for c in chains], kind="stable"), [], 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(chains[order[end]]) <= most:
            end += 1
        these = order[at:end]
        size = np.array([len(chains[k]) for k in these])
        bins = np.zeros((len(these), size[-1], WIDTH), dtype=np.int64)
        for j, k in enumerate(these):
            bins[j, : size[j]] = chains[k]
        out.append((these, bins, size))
        at = end
    return out


def _ascend(field: Field, batches, labels: list[np.ndarray], steps: int) -> Field:
    """Adam on the penalised likelihood of labelled chains."""
    n = OFFSETS[-1]
    truth = np.zeros(n + 4)
    for these, bins, size in batches:
        for j, k in enumerate(these):
            y = labels[k].astype(np.int64)
            np.add.at(truth, bins[j, : size[j]][y == 1].ravel(), 1)
            np.add.at(truth, n + 2 * y[:-1] + y[1:], 1)
    total = max(1, sum(int(size.sum()) for _, _, size in batches))
    x = np.concatenate([field.weights, field.moves.ravel()])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        now, g = Field(x[:n], x[n:].reshape(2, 2)), truth - PENALTY * x
        for _, bins, size in batches:
            content, moves = _sums(now, bins, size)
            g[:n] -= np.bincount(bins.ravel(), weights=np.repeat(content.ravel(), WIDTH), minlength=n)
            g[n:] -= moves.ravel()
        g /= total
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(x[:n], x[n:].reshape(2, 2))


def fit(chains: list[np.ndarray], words: list[np.ndarray], good: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS) -> Field | None:
    """The field of chains of good and poor documents; None if one kind is missing."""
    good = np.asarray(good, dtype=bool)
    if not len(good) or good.all() or not good.any():
        return None
    batches, labels = _padded(chains), [np.full(len(c), g) for c, g in zip(chains, good, strict=True)]
    field = _ascend(Field(np.zeros(OFFSETS[-1]), np.zeros((2, 2))), batches, labels, steps)
    for _ in range(rounds):
        for these, bins, size in batches:
            content, _ = _sums(field, bins, size)
            for j, k in enumerate(these):
                if good[k]:
                    continue
                y = field.decode(chains[k])
                rest = words[k].sum() / 2 - words[k][~y].sum()  # words that are yet to be boilerplate
                for line in np.argsort(content[j, : size[j]], kind="stable").tolist():
                    if rest <= 0:
                        break
                    if y[line]:
                        y[line] = False
                        rest -= words[k][line]
                labels[k] = y
        field = _ascend(field, batches, labels, steps // 2)
    return field


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Field | None:
    """Fit on the labelled rows of docs of least hash, `sample` at most."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    known = F.broadcast(common.few(known, sample))  # of bounded size
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(known, "id")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [measure(t) for t in part.column(1).to_pylist()]
                ok = [0 < len(m.words) <= LINES for m in found]
                kept = [m for m, o in zip(found, ok, strict=True) if o]
                part = part.filter(pa.array(ok, pa.bool_()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([m.bins.tobytes() for m in kept], pa.binary()), pa.array([m.words.astype(np.int32).tobytes() for m in kept], pa.binary())],
                    names=["key", "label", "bins", "words"],
                )

    rows = rows.select(F.xxhash64("id", "text").alias("key"), "text", "label").mapInArrow(run, "key long, label int, bins binary, words binary")
    got = rows.orderBy("key", "label").limit(sample).toPandas()
    chains = [np.frombuffer(x, dtype=np.int16).reshape(-1, WIDTH).astype(np.int64) for x in got["bins"]]
    return fit(chains, [np.frombuffer(x, dtype=np.int32) for x in got["words"]], got["label"].to_numpy() == 1)


def label(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts of the rules, base_failed, lines array<boolean> (content or not, of each line with words), content_share
    (of words) and kept: one row per row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [measure(t) for t in part.column(1).to_pylist()]
                lines = [field.decode(m.bins) if field is not None and len(m.words) else np.ones(len(m.words), dtype=bool) for m in found]
                share = [float(m.words[y].sum() / m.n_words) if m.n_words else 0.0 for m, y in zip(found, lines, strict=True)]
                failed = [m.failed for m in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        *(pa.array([getattr(m, c) for m in found], pa.int64()) for c in counts),
                        pa.array(failed, pa.bool_()),
                        pa.array([y.tolist() for y in lines], pa.list_(pa.bool_())),
                        pa.array(share, pa.float64()),
                        pa.array([s >= SHARE and not f for s, f in zip(share, failed, strict=True)], pa.bool_()),
                    ],
                    names=["doc_id", *counts, "base_failed", "lines", "content_share", "kept"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} bigint' for c in counts)}, base_failed boolean, lines array<boolean>, content_share double, kept boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = label(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")
