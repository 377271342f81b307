"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its lower-case words and their stems, word pairs, and pairs that skip one
or two words.
FTRL-proximal keeps a rate for each coordinate and its L1 term leaves few weights; they are stored as sorted
(hash, weight) arrays, small enough to broadcast (at most the features of the bounded sample).

Fit: at most ``SAMPLE_PER_CLASS`` labelled ids of each class, the first by a hash of the id, one text each; a fifth of
them is kept apart to calibrate slope and intercept at the classes' true odds. Scoring reads each text once and shuffles nothing.

Null text counts as empty and gets the intercept's score. Repeated rows each get a score. Null labels are left out; an
id labelled more than once counts as toxic if any label says so. Without labels of both classes the score is the toxic
share (0 if there are no labels). An empty table gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, logistic, slices, text_or_empty

SAMPLE_PER_CLASS = 2000
EPOCHS = 10
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.0
#: Every so-many-th sampled row only calibrates, if that leaves enough toxic ones.
CALIBRATE, ENOUGH = 5, 8
#: A feature must occur in so many sampled rows.
MIN_ROWS = 3
FOLDS = 5
#: A longer word also counts by so many leading bytes.
STEM_BYTES = 6

_PUNCT = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)
_HIGH = np.uint64(32)
_STEM = np.uint64(0x6C62272E07BB0142)
_SALTS = tuple(np.uint64(x) for x in (0x51ED270B, 0xA24BAED4, 0x8CB92BA7))


def _mix(a: np.ndarray) -> np.ndarray:
    a = a * _MULT
    return (a ^ (a >> _SHIFT)) * _MULT


def features(text: str | None) -> np.ndarray:
    """Hashes (uint32) of words, pairs and skip pairs, in text order with repeats."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_PUNCT).split()
    if not words:
        return np.empty(0, np.uint32)
    w = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    stems = np.fromiter((zlib.crc32(x[:STEM_BYTES]) for x in words if len(x) > STEM_BYTES), np.uint64)
    parts = [_mix(w)]
    for gap, salt in enumerate(_SALTS, 1):
        if len(w) > gap:
            parts.append(_mix(parts[0][:-gap] ^ (w[gap:] * salt)))
    return (np.concatenate([*parts, _mix(stems ^ _STEM)]) >> _HIGH).astype(np.uint32)


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[self.keys & np.uint32(0xFFFF)] = True

    def score(self, text: str | None) -> float:
        f = features(text)
        f = np.unique(f[self.sieve[f & np.uint32(0xFFFF)]])
        total = self.bias
        if len(f) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
            total += float(self.weights[at][self.keys[at] == f].sum())
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, odds: float) -> Model:
    """FTRL-proximal over ``rows`` of distinct hashes. ``odds``: toxic to clean rows among all labels."""
    n_pos = int(labels.sum())
    if not len(rows) or n_pos in (0, len(rows)):
        share = odds / (1 + odds) if np.isfinite(odds) else 1.0
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(np.empty(0, np.uint32), np.empty(0), float(np.log(share / (1 - share))))
    keys, counts = np.unique(np.concatenate(rows), return_counts=True)
    keys = keys[counts >= min(MIN_ROWS, len(rows))]
    local = []
    for r in rows:
        at = np.minimum(np.searchsorted(keys, r), max(len(keys) - 1, 0))
        local.append(at[keys[at] == r] if len(keys) else at[:0])
    z, n = np.zeros(len(keys)), np.zeros(len(keys))
    bias_z = bias_n = 0.0
    order = np.random.default_rng(7)
    aside = np.arange(len(rows)) % CALIBRATE == 0
    if min(labels[aside].sum(), (1 - labels[aside]).sum()) < ENOUGH:
        aside[:] = False
    learn = np.flatnonzero(~aside)

    def weight(zi, ni, l1=L1):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in order.permutation(learn):
            at = local[i]
            zi, ni = z[at], n[at]
            w, b = weight(zi, ni), float(weight(np.float64(bias_z), np.float64(bias_n), 0.0))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - labels[i]
            s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] = zi + g - s * w
            n[at] = ni + g * g
            s = (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA
            bias_z, bias_n = bias_z + g - s * b, bias_n + g * g
    w = weight(z, n)
    held = w != 0
    bias = float(weight(np.float64(bias_z), np.float64(bias_n), 0.0))
    excess = n_pos / (len(rows) - n_pos) / odds  # how much the sample favours toxic rows
    if not aside.any():
        return Model(keys[held], w[held], bias - float(np.log(excess)))
    at = np.flatnonzero(aside)
    margins = np.array([w[local[i]].sum() for i in at]) + bias
    a, b = logistic(margins, labels[at], np.where(labels[at] == 1, 1.0, excess))
    a = max(a, 1e-3)
    return Model(keys[held], w[held] * a, bias * a + b)


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", may_learn: Column | None = None) -> Model:
    """Fit on a bounded sample of the labelled rows for which ``may_learn`` (on ``doc_id``) holds."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    if may_learn is not None:
        known = known.filter(may_learn)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {int(r["toxic"]): r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect() if r["toxic"] in (0, 1)}
    chosen = None
    for c in (0, 1):
        one = known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS)
        chosen = one if chosen is None else chosen.unionByName(one)
    # Bounded: 2 * SAMPLE_PER_CLASS rows of two integers.
    picked = docs.select("doc_id", text_or_empty(text).alias("body")).join(F.broadcast(chosen), "doc_id")
    # An id's rows may be many; one stays, the least by a hash of its text.
    picked = picked.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min_by("body", F.struct(F.xxhash64("body"), "body")).alias("body"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hashes = [np.unique(features(t)).tobytes() for t in b.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(hashes, pa.binary())], ["doc_id", "toxic", "hashes"])

    got = picked.mapInArrow(encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, hashes binary").collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["hashes"])))
    rows = [np.frombuffer(bytes(r["hashes"]), np.uint32) for r in got]
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    return fit(rows, np.array([r["toxic"] for r in got], float), pos / neg if neg else (float("inf") if pos else 0.0))


def scored(docs: DataFrame, model: Model, *, text: str = "text", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of ``docs`` with ``score`` (double)."""
    schema = docs.select(*columns).schema.add("score", "double")
    names = [f"c{i}" for i in range(len(columns))]
    sent = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for b in slices(batches, 1024):
            scores = [own.score(t) for t in b.column("__body").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(scores, pa.float64())], [*columns, "score"])

    narrow = docs.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)), F.col(text).alias("__body"))
    return narrow.mapInArrow(run, schema)


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``: learns from ids whose crc32 modulo ``FOLDS`` isn't 0, scores all."""
    model = train(docs, labels, may_learn=fold(F.col("doc_id"), FOLDS) != 0)
    out = scored(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns; row order isn't kept."""
    model = train(docs, labels, may_learn=fold(F.col("doc_id"), FOLDS) != 0)
    held = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias))
    at = held.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for b in slices(batches, 1024):
            yield b.filter(pa.array([own.score(t) < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
