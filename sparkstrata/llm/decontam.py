"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every run of ``SEED_WORDS`` words of a benchmark item is a candidate seed. A first pass over the whole corpus counts
the documents that hold each candidate; an item keeps its rarest ``RARE_SHARE`` (ties stay), so common phrases start no
alignment, while a passage that very many documents hold still keeps its seeds. A second pass finds seeds in every
text with one automaton and aligns each neighbourhood of hits with the item, word by word: +2 match, -1 mismatch, -1
gap. An alignment's score is its share of the item's own score; ``THRESHOLD`` and above is a leak.

Cost: the corpus isn't shuffled, seeds reach it by broadcast. The benchmark is cut into blocks of at most about
``BLOCK_CHARS`` characters, each scanned by itself, so what is broadcast is bounded whatever the benchmark's size.
A leak that a third of all documents hold costs each of them one alignment.

Null texts count as empty; empty items match nothing; items under ``SHORT_WORDS`` words must match fully. Repeated
documents and repeated items each get their rows. Empty tables give an empty result. Words are compared in lower case
without punctuation. Further columns may have any names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

SEED_WORDS = 3
RARE_SHARE = 0.75
THRESHOLD = 0.45
SHORT_WORDS = 8
BLOCK_CHARS = 8_000_000
MATCH, MISS, GAP = 2, -1, -1

_PUNCT = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def plain(text: str | None) -> str:
    """Lower-case words between single spaces, a space at either end."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_PUNCT).split()
    return f" {b' '.join(words).decode('utf-8', 'replace')} " if words else ""


def seeds_of(words: list[str]) -> list[tuple[int, str]]:
    """(place, seed) of every candidate."""
    n = min(SEED_WORDS, len(words))
    return [(i, f" {' '.join(words[i : i + n])} ") for i in range(len(words) - n + 1)] if n else []


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local score of word codes ``a`` in ``b`` and where in ``b`` it ends. Linear gaps."""
    best, end = 0, 0
    steps = -GAP * np.arange(len(b))
    row = np.zeros(len(b) + 1, np.int64)
    for code in a:
        t = np.maximum(row[:-1] + np.where(b == code, MATCH, MISS), row[1:] + GAP)
        t = np.maximum(t, 0)
        row[1:] = np.maximum.accumulate(t + steps) - steps
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


class Scanner:
    """One block of items. ``seeds``: seed -> its (item index, place)."""

    def __init__(self, items: list[tuple], seeds: dict[str, list[tuple[int, int]]]) -> None:
        self.items = [(i, words) for i, words in items]
        self.machine = ahocorasick.Automaton()
        for seed, where in seeds.items():
            self.machine.add_word(seed, (seed, where))
        if seeds:
            self.machine.make_automaton()
        self.any = bool(seeds)

    def hits(self, text: str) -> Iterator[tuple[int, tuple[str, list]]]:
        return self.machine.iter(text) if self.any and text else iter(())

    def leaks(self, text: str) -> list[tuple[int, float, int]]:
        """(item index, score, word where the best alignment ends) of the items at or above the threshold."""
        near: dict[int, set[int]] = defaultdict(set)
        count, at = 0, 1
        for end, (seed, where) in self.hits(text):
            begin = end - len(seed) + 1
            count += text.count(" ", at, begin + 1) if begin >= at else -text.count(" ", begin + 1, at)
            at = begin + 1
            for item, place in where:
                near[item].add(count - place)
        if not near:
            return []
        words = text.split()
        codes: dict[str, int] = {}
        found = []
        for item, origins in near.items():
            own = self.items[item][1]
            need = 1.0 if len(own) < SHORT_WORDS else THRESHOLD
            pad = len(own) // 2 + 2
            a = np.array([codes.setdefault(w, len(codes)) for w in own])
            best = (0.0, 0)
            places = sorted(origins)
            i = 0
            while i < len(places):
                lo = max(places[i] - pad, 0)
                hi = places[i] + len(own) + pad
                while i < len(places) and places[i] <= hi:  # neighbours share a window, but it may not grow without end
                    if places[i] + len(own) + pad - lo > 8 * len(own) + 64:
                        break
                    hi = max(hi, places[i] + len(own) + pad)
                    i += 1
                b = np.array([codes.setdefault(w, len(codes)) for w in words[lo:hi]])
                if len(b):
                    score, end = align(a, b)
                    best = max(best, (score / (MATCH * len(own)), lo + end))
            if best[0] >= need:
                found.append((item, best[0], best[1]))
        return found


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The benchmark in bounded parts: (item id, words)."""
    rows = benchmark.select(F.col(item_id).alias("i"), text_or_empty(text).alias("t"))
    size = rows.agg(F.sum(F.length("t") + 8)).first()[0] or 0
    n = max(1, -(-size // BLOCK_CHARS))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r["i"], plain(r["t"]).split()) for r in sorted(part.collect(), key=lambda r: (str(r["i"]), r["t"]))]


def rare_seeds(docs: DataFrame, items: list[tuple], *, text: str = "text") -> dict[str, list[tuple[int, int]]]:
    """Each item's rarest candidates by the number of documents of the whole corpus that hold them."""
    where: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for i, (_, words) in enumerate(items):
        for place, seed in seeds_of(words):
            where[seed].append((i, place))
    names = sorted(where)
    index = {s: [(k, 0)] for k, s in enumerate(names)}
    sent = docs.sparkSession.sparkContext.broadcast(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner([], {s: [(k, 0)] for k, s in enumerate(sent.value)})
        df = np.zeros(len(sent.value), np.int64)
        for b in slices(batches, 1024):
            for t in b.column(0).to_pylist():
                got = {w[0][0] for _, (_, w) in own.hits(plain(t))}
                df[list(got)] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], ["seed", "n"])

    if not index:
        return {}
    # Bounded: one row for each candidate of the block.
    counts = docs.select(F.col(text).alias("t")).mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()
    df = {names[r["seed"]]: r["n"] for r in counts}
    kept: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for i, (_, words) in enumerate(items):
        own = seeds_of(words)
        ranks = sorted(df.get(s, 0) for _, s in own)
        if own:
            limit = ranks[min(len(ranks) - 1, int(len(ranks) * RARE_SHARE))]
            for place, s in own:
                if df.get(s, 0) <= limit:
                    kept[s].append((i, place))
    return dict(kept)


def leaks(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``doc_id, item_id, score, end_word``: one row for each document and item that it holds."""
    out = None
    for items in _blocks(benchmark, item_id, "text"):
        sent = docs.sparkSession.sparkContext.broadcast((items, rare_seeds(docs, items, text=text)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = Scanner(*sent.value)
            for b in slices(batches, 1024):
                rows = [(k, own.items[i][0], s, e) for k, t in enumerate(b.column(1).to_pylist()) for i, s, e in own.leaks(plain(t))]
                k, i, s, e = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(k, pa.int64())), pa.array(i, item_type), pa.array(s, pa.float64()), pa.array(e, pa.int64())], ["doc_id", "item_id", "score", "end_word"])

        schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {benchmark.schema[item_id].dataType.simpleString()}, score double, end_word long"
        item_type = _arrow_type(benchmark, item_id)
        one = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that ``leaks`` has no row for, with all their columns.

    Seeds are counted on all of ``docs``, as in ``leaks``; each block then leaves out rows of what earlier ones left.
    """
    at = docs.columns.index(text)
    left = docs
    for items in _blocks(benchmark, item_id, "text"):
        sent = docs.sparkSession.sparkContext.broadcast((items, rare_seeds(docs, items, text=text)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = Scanner(*sent.value)
            for b in slices(batches, 1024):
                yield b.filter(pa.array([not own.leaks(plain(t)) for t in b.column(at).to_pylist()], pa.bool_()))

        left = left.mapInArrow(run, docs.schema)
    return left
