"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file. The normaliser writes a space as the word mark and puts one mark in
front. The piece machine is a trie that reads characters and writes piece ids; byte fallback adds, for every character,
an arc that writes its UTF-8 bytes. An input is composed with them on the fly: states are places (with the piece that led there), weights
live in the tropical semiring (sum along a path, least over paths), and the shortest path is the encoding.

Unigram models weigh an arc by the piece's negative log-probability. For BPE models the weights alone can't repeat the
merges, so the machine also has a bigram restriction: two pieces may follow each other only if merging their joined
characters gives back just these two. A sequence in which every neighbour pair is so is the merges' own result and the
only one, so the shortest path is exact. No piece with a mark inside or a line feed exists, therefore the machine is
run on chunks between these, and chunk results are kept in a bounded cache.

Null text counts as empty and gives no tokens. Repeated rows each get a result. An empty table gives an empty result.
Decoding gives the input back, except that a literal word mark in it comes back as a space and U+0000-like characters
without a byte piece would be the unknown piece. Further columns may have any names.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_or_empty

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bound of the compiled tables' size that may be broadcast; a vocabulary is fixed, it doesn't grow with the data.
MAX_MODEL_BYTES = 64_000_000
#: Chunks of one generation; a worker keeps two, some 140 bytes a chunk.
CACHE_CHUNKS = 200_000
#: Answers of the restriction that a worker keeps.
CACHE_PAIRS = 300_000
CACHE_CHARS = 48
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _BPE = 1, 2


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffers message (wire format)."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = buf[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    i = 0
    while i < len(buf):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            if tag & 7 == 2:
                size, i = varint(i)
            else:
                size = 8 if tag & 7 == 1 else 4
            value, i = buf[i : i + size], i + size
        yield tag >> 3, value


class Transducer:
    """Compiled normaliser, pieces and byte fallback. ``model``: the bytes of a model file."""

    def __init__(self, model: bytes) -> None:
        if len(model) > MAX_MODEL_BYTES:
            raise ValueError("model file is too large to broadcast")
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        kind, norm = _UNIGRAM, {}
        for tag, value in _fields(model):
            if tag == 1:
                d = dict(_fields(value))
                self.pieces.append(d[1].decode())
                self.scores.append(struct.unpack("<f", d[2])[0] if 2 in d else 0.0)
                self.kinds.append(d.get(3, _NORMAL))
            elif tag == 2:
                kind = dict(_fields(value)).get(3, _UNIGRAM)
            elif tag == 3:
                norm = dict(_fields(value))
        if norm.get(2) or norm.get(4, 1):
            raise ValueError("only identity normalisers that keep white space are compiled")
        if kind not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models are compiled")
        self.bpe, self.prefix = kind == _BPE, bool(norm.get(3, 1))
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (_NORMAL, _USER)}
        self.unknown = self.kinds.index(_UNKNOWN) if _UNKNOWN in self.kinds else 0
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == _BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.cuts = not any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in self.ids)
        # A chunk may also end between a letter and a sign that follows no letter in any piece.
        met = {p[i + 1] for p in self.ids for i in range(len(p) - 1) if p[i].isalpha()}
        signs = "".join(re.escape(c) for c in ".,;:!?#$%&*|" if c not in met)
        # Chunks are taken before spaces become marks, when most texts have one byte a character, and so have the cache's keys.
        word = f"[ {MARK}]*[^\\W\\d_]+(?=[{signs}])|" if signs else ""
        self.chunk = re.compile(f"\n|{word}[ {MARK}]+[^ {MARK}\n]*|[^ {MARK}\n]+") if self.cuts else re.compile("(?s).+")
        self.tied = {c for p, k in Counter(self.scores[i] for i in self.ids.values()).items() if k > 1 for q, i in self.ids.items() if self.scores[i] == p for c in q} if self.bpe else set()
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.weights = [-x for x in self.scores]
        self.root = self._compile()
        self.out = [self._surface(i) for i in range(len(self.pieces))]

    def _surface(self, i: int) -> bytes:
        if self.kinds[i] == _BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.kinds[i] == _UNKNOWN:
            return b" \xe2\x81\x87 "
        return b"" if self.kinds[i] == _CONTROL else self.pieces[i].replace(MARK, " ").encode()

    def chunks(self, text: str) -> list[str]:
        """The first machine's first half: a space in front of non-empty text, cut into chunks. Spaces become marks in each."""
        return self.chunk.findall(" " + text if self.prefix and text else text)

    def _merge(self, text: str) -> list[tuple[str, str, str]]:
        """Best-scored, leftmost merges of neighbouring symbols, from characters on: (symbol, its left, its right)."""
        parts = [(c, "", "") for c in text]
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                p = self.ids.get(parts[i][0] + parts[i + 1][0])
                if p is not None and (best is None or self.scores[p] > best):
                    best, at = self.scores[p], i
            if at < 0:
                return parts
            a, b = parts[at][0], parts[at + 1][0]
            parts[at : at + 2] = [(a + b, a, b)]

    def _made(self, piece: str) -> tuple[str, str] | None:
        """The two parts of a piece's last merge, ("", "") for one character; None if merges never give the piece."""
        got = self.parts.get(piece, False)
        if got is False:
            whole = self._merge(piece)
            got = self.parts[piece] = whole[0][1:] if len(whole) == 1 else None
        return got

    def _score(self, symbol: str) -> float:
        p = self.ids.get(symbol)
        return float("inf") if p is None else self.scores[p]

    def follows(self, a: str, b: str, key: int) -> bool:
        """The bigram restriction, kept by ``key``: merging the characters of both gives back these two."""
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        got = self.pairs[key] = self._separate(a, b)
        return got

    def _separate(self, a: str, b: str) -> bool:
        """Walks back through the merges along the border, latest first. A symbol pair at the border that could merge, and
        would have come before the merge just taken back, would have joined the two."""
        if self.tied & {a[-1], b[0]}:  # runs of marks have equal scores, where only the full merge tells
            return [x[0] for x in self._merge(a + b)] == [a, b]
        left, right = a, b
        before, leftmost = float("-inf"), False  # a merge at the border must score below this; equal counts if it is left of it
        while True:
            joined = self._score(left + right) if left + right in self.ids else None
            if joined is not None and (joined > before or (leftmost and joined == before)):
                return False
            l_parts, r_parts = self._made(left) or ("", ""), self._made(right) or ("", "")
            if not l_parts[0] and not r_parts[0]:
                return True
            if l_parts[0] and (not r_parts[0] or self._score(left) < self._score(right)):
                before, leftmost, left = self._score(left), False, l_parts[1]
            else:
                before, leftmost, right = self._score(right), True, r_parts[0]

    def _compile(self) -> dict:
        """The piece machine: for each state its arcs, character -> (state, piece id or -1 where none ends)."""
        root: dict = {}
        for piece, i in self.ids.items():
            if self.bpe and self._made(piece) is None:
                continue  # no merges lead to it
            states = root
            for c in piece[:-1]:
                states = states.setdefault(c, [{}, -1])[0]
            states.setdefault(piece[-1], [{}, -1])[1] = i
        return root

    def shortest_path(self, text: str) -> list[int | str]:
        """Piece ids (or single characters for byte fallback) along the least path of the composition with ``text``.

        One state for each place is enough: without the restriction the best path to a place is a best path's start, and
        with it only one path leads to each place, the merges' own result on the text so far. Byte fallback costs more
        than any piece; a BPE arc costs 1, because there the restriction alone decides.
        """
        n, bpe, root, pairs, weights = len(text), self.bpe, self.root, self.pairs, self.weights
        none = float("inf")
        cost, last, begin = [none] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        cost[0] = 0.0
        for at in range(n):
            now = cost[at]
            if now == none:
                continue
            arcs, here, end = root, last[at], at
            for c in text[at : at + self.longest]:
                arc = arcs.get(c)
                if arc is None:
                    break
                end += 1
                arcs, piece = arc
                if piece < 0:
                    continue
                total = now + (1.0 if bpe else weights[piece])
                if total >= cost[end] or (bpe and cost[end] != none):
                    continue
                if bpe and here >= 0:
                    key = here << 20 | piece
                    fine = pairs.get(key)
                    if fine is None:
                        fine = self.follows(self.pieces[here], self.pieces[piece], key)
                    if not fine:
                        continue
                cost[end], last[end], begin[end] = total, piece, at
            if text[at] not in self.ids and now + 1e6 < cost[at + 1]:
                cost[at + 1], last[at + 1], begin[at + 1] = now + 1e6, -1, at
        at, path = n, []
        while at:
            path.append(last[at] if last[at] >= 0 else text[at - 1])
            at = begin[at]
        return path[::-1]

    def _write(self, path: list[int | str]) -> Iterator[int]:
        for part in path:
            if isinstance(part, int):
                yield part
            elif self.bytes:
                yield from (self.bytes[b] for b in part.encode("utf-8", "replace"))
            else:
                yield self.unknown

    def codes(self, text: str | None) -> bytes:
        """Piece ids, four bytes each in the machine's order. Ids are kept and joined as bytes: half of what tuples take."""
        out: list[bytes] = []
        young, old = self.young, self.old
        for chunk in self.chunks(text or ""):
            ids = young.get(chunk)
            if ids is None:
                ids = old.get(chunk)
                if ids is None:
                    ids = array("i", self._write(self.shortest_path(chunk.replace(" ", MARK)))).tobytes()
                if len(chunk) <= CACHE_CHARS:
                    if len(young) >= CACHE_CHUNKS:  # what wasn't met for a whole generation goes
                        old = self.old = young
                        young = self.young = {}
                    young[chunk] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.codes(text)).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The inverse: surfaces joined, bytes read as UTF-8, the mark in front dropped."""
        out = self.out
        text = b"".join([out[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_COMPILED: dict[int, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """One machine, with its chunk cache, for each Python worker."""
    key = hash(model)
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Transducer(model)
    return _COMPILED[key]


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, *, text: str = "text", columns: tuple[str, ...] = ("doc_id",), model_path: str = MODEL_PATH) -> DataFrame:
    """``columns``, ``n_tokens``, ``ids`` and ``round_trip`` (decoding gave the text back). The driver reads the model."""
    names = [f"c{i}" for i in range(len(columns))]
    schema = docs.select(*columns).schema.add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType())).add("round_trip", "boolean")
    sent = docs.sparkSession.sparkContext.broadcast(_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = compiled(sent.value)
        for b in slices(batches, 256):
            texts = b.column("__body").to_pylist()
            codes = [own.codes(t) for t in texts]
            same = [own.decode(array("i", c)) == t.replace(MARK, " ") for c, t in zip(codes, texts, strict=True)]
            sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            flat = np.frombuffer(b"".join(codes), np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sizes), lists, pa.array(same, pa.bool_())], [*columns, "n_tokens", "ids", "round_trip"])

    narrow = docs.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)), text_or_empty(text).alias("__body"))
    return narrow.mapInArrow(run, schema)


def decoded(tokens: DataFrame, *, ids: str = "ids", columns: tuple[str, ...] = ("doc_id",), model_path: str = MODEL_PATH) -> DataFrame:
    """``columns`` and ``text``."""
    names = [f"c{i}" for i in range(len(columns))]
    schema = tokens.select(*columns).schema.add("text", "string")
    sent = tokens.sparkSession.sparkContext.broadcast(_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = compiled(sent.value)
        for b in slices(batches, 256):
            texts = [own.decode(i or []) for i in b.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(texts, pa.string())], [*columns, "text"])

    return tokens.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)), F.col(ids).alias("__ids")).mapInArrow(run, schema)
