"""Operator 9: byte-level BPE by a lazily determinised finite-state transducer.

A sequence of tokens is the encoding of its bytes exactly when each adjacent pair of tokens encodes to itself. This
makes encoding a nondeterministic transducer over bytes: a configuration is (token before, place in the vocabulary
trie), and a token may end where it agrees with the token before it. Determinisation keeps all live configurations in
one state. After each byte exactly one configuration may end, as what precedes has one encoding; a transition outputs
that token. Which of these tokens belong to the encoding shows once all live configurations go back to one place in the
text, a few tokens behind: lookahead is bounded by the vocabulary's longest tokens. Places are compared every `WINDOW`
bytes and at the end of a piece, and what is settled is emitted. States and transitions are built when a text first needs
them, up to `max_states`; past that number a state that isn't in the table is stepped through by its configurations and
not kept, so memory is bounded on any input.

The pattern splits a text; a piece that is a token by itself is that token, any other runs through the transducer.
Results of short pieces are kept in two generations of a table of bounded size. Decoding streams tokens through an incremental UTF-8 state
machine: a state is the unfinished tail of a character, a transition a token, an output whole characters.

Defined cases: null counts as empty, an empty text has no ids; texts are processed whole, pieces of any length in one
left-to-right pass; ids that don't end on a whole character leave their tail to `finish`, which replaces it by U+FFFD,
as do ill-formed bytes within; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PIECES = 400_000
STATES = 200_000
WINDOW = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Bytes to token ids."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pairs: dict[int, bool] = {}
        # the trie: a dictionary of node * 256 + byte to node; a node's token if it is one that merging reaches
        self.child: dict[int, int] = {}
        self.token, self.depth = [-1], [0]
        for b, i in ranks.items():
            node = 0
            for x in b:
                if (nxt := self.child.get(node << 8 | x)) is None:
                    nxt = self.child[node << 8 | x] = len(self.token)
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token[node] = i
        self.made: dict[int, tuple[int, int] | None] = {}
        self.size = {i: len(b) for b, i in ranks.items()}
        # states by number; transitions: state * 256 + byte to the next state and the token that ends there
        self.states: list[tuple] = [((-1, 0),)]
        self.numbers: dict[tuple, int] = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """Merging by rank down to `least` parts; used on single tokens' bytes, to build transitions."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte or a token that merging doesn't reach."""
        if token not in self.made:
            data, found = self.bytes_of[token], None
            parts = self.merged(data, 2)
            if len(parts) == 2 and all(p in self.ranks for p in parts):
                found = (self.ranks[parts[0]], self.ranks[parts[1]])
            self.made[token] = found
        return self.made[token]

    def agree(self, before: int, after: int) -> bool:
        """Whether the two tokens, side by side, encode to themselves; `before` is -1 at a piece's start.

        Merges are undone from the latest back. If at some point the parts that touch would merge earlier than the
        merges already undone, merging crosses the seam and the pair isn't an encoding.
        """
        if (ok := self.pairs.get((before << 20) | after)) is not None:
            return ok
        if before < 0:
            ok = len(self.merged(self.bytes_of[after])) == 1
        else:
            ok, ceiling, left, right = self.agree(-1, before) and self.agree(-1, after), 1 << 60, before, after
            while ok:
                if self.ranks.get(self.bytes_of[left] + self.bytes_of[right], 1 << 60) < ceiling:
                    ok = False
                    break
                of_left, of_right = self.halves(left), self.halves(right)
                if of_left is None and of_right is None:
                    break
                if of_right is None or (of_left is not None and left > right):
                    ceiling, left = left, of_left[1]
                else:  # at equal rank the left one merges first, so the right one is undone first
                    ceiling, right = right + 1, of_right[0]
        if len(self.pairs) > 8 * self.max_states:
            self.pairs.clear()
        self.pairs[(before << 20) | after] = ok
        return ok

    def _after(self, configs: Iterable[tuple[int, int]], byte: int) -> tuple[tuple, int]:
        """The configurations after one more byte, and the token that ends there."""
        child, token, pairs, live, ended = self.child, self.token, self.pairs, [], -1
        for before, node in configs:
            nxt = child.get(node << 8 | byte)
            if nxt is None:
                continue
            live.append((before, nxt))
            if ended < 0 and (t := token[nxt]) >= 0:
                ok = pairs.get((before << 20) | t)
                if self.agree(before, t) if ok is None else ok:
                    ended = t
        live.append((ended, 0))
        return tuple(live), ended

    def _move(self, state: int, configs: tuple, byte: int) -> tuple[int, tuple, int]:
        """A transition that isn't in the table: the next state (-1: only its configurations), and the token."""
        configs, token = self._after(self.states[state] if state >= 0 else configs, byte)
        target = self.numbers.get(configs, -1)
        if target < 0 and len(self.states) < self.max_states:
            target = self.numbers[configs] = len(self.states)
            self.states.append(configs)
        if state >= 0 and target >= 0 and len(self.moves) < 4 * self.max_states:
            self.moves[state << 8 | byte] = (target, token)
        return target, configs, token

    def _back(self, ended: list[int], at: int) -> list[int]:
        """The tokens of the first `at` bytes, the last token first."""
        out = []
        while at:
            out.append(t := ended[at - 1])
            at -= self.size[t]
        return out

    def _settled(self, ended: list[int], configs: tuple) -> list[int]:
        """Takes from `ended` as many bytes as all configurations agree on, and gives their tokens."""
        common = None
        for _, node in configs:
            at = len(ended) - self.depth[node]
            places = {at}
            while at:
                at -= self.size[ended[at - 1]]
                places.add(at)
            common = places if common is None else common & places
        at = max(common)
        out = self._back(ended, at)[::-1]
        del ended[:at]
        return out

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        out: list[int] = []
        ended: list[int] = []  # the token that ends at each byte not yet emitted
        state, configs, known = 0, (), self.moves.get
        for at in range(0, len(data), WINDOW):
            for x in data[at : at + WINDOW]:
                hit = known(state << 8 | x)
                if hit is None:
                    state, configs, token = self._move(state, configs, x)
                else:
                    state, token = hit
                ended.append(token)
            if at + WINDOW < len(data):
                out += self._settled(ended, self.states[state] if state >= 0 else configs)
        return out + self._back(ended, len(ended))[::-1]


class Pieces(dict):
    """Ids by piece, those not there yet computed. Two generations of at most `most` pieces are kept."""

    def __init__(self, machine: Transducer, most: int):
        self.machine, self.most = machine, most
        self.old: dict[str, list[int]] = {}

    def __missing__(self, piece: str) -> list[int]:
        if (ids := self.old.get(piece)) is None:
            ids = self.machine.piece(piece.encode("utf-8"))
        if len(piece) <= 64:  # longer ones hardly come again
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, pieces: int = PIECES):
        self.split = regex.compile(pattern).findall
        self.machine = Transducer(ranks)
        self.pieces = Pieces(self.machine, pieces)

    def __call__(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))


class Decoder:
    """Token ids to text, piecewise: `feed` gives the characters that are complete, `finish` the rest."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.moves: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}
        self.loops: dict[int, str] = {}  # the start state's transitions to itself
        self.tail = b""

    @staticmethod
    def whole(data: bytes) -> int:
        """Length of the part that doesn't end within a character."""
        for back in range(1, min(3, len(data)) + 1):
            x = data[-back]
            if x >= 0xC0:
                return len(data) - back if (2 if x < 0xE0 else 3 if x < 0xF0 else 4) > back else len(data)
            if x < 0x80:
                break
        return len(data)

    def feed(self, ids: Iterable[int]) -> Iterator[str]:
        tail, moves = self.tail, self.moves
        at = moves[tail]
        for i in ids:
            hit = at.get(i)
            if hit is None:
                data = tail + self.bytes_of[i]
                cut = self.whole(data)
                hit = at[i] = (data[:cut].decode("utf-8", "replace"), data[cut:])
                moves.setdefault(hit[1], {})
                if not tail and not hit[1]:
                    self.loops[i] = hit[0]
            yield hit[0]
            if hit[1] is not tail:
                tail = hit[1]
                at = moves[tail]
        self.tail = tail

    def finish(self) -> str:
        rest, self.tail = self.tail.decode("utf-8", "replace"), b""
        return rest

    def __call__(self, ids: list[int]) -> str:
        try:  # never leaving the start state
            return "".join(map(self.loops.__getitem__, ids))
        except KeyError:
            pass
        return "".join(self.feed(ids)) + self.finish()


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """Kept by a Python worker for its later tasks, with the states and pieces found so far."""
    ranks = read_ranks(ranks_path)
    return Encoder(ranks, pattern), Decoder(ranks)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string (the text that the ids stand for). ranks_path: there on every machine."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encode, decode = codec(ranks_path, pattern)
        gc.disable()  # the tables are many live tuples, which it would walk again and again; nothing here makes cycles
        try:
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    part = b.slice(at, 512)
                    ids = [encode(t) if t else [] for t in part.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(decode, ids), pa.string())], names=["doc_id", "ids", "decoded"]
                    )
        finally:
            gc.enable()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_decode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
