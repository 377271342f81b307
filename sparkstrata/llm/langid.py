"""Language identification by interpolated Kneser-Ney character models.

A model holds, for each order, one sorted array of n-gram hashes over all languages and a matrix of their interpolated
log-probabilities, one column for each language; and sorted context hashes with their back-off weights. A character's
log-probability is read from the longest n-gram that any language has seen. The language of the lowest cross-entropy
per character wins.

Fit: at most ``SAMPLE_PER_LANGUAGE`` rows of each language, chosen by a hash of the id, whole texts; every fifth is
kept for calibration. Calibration turns the lead over the second language into a probability (logistic), and sets for
each language the cross-entropy above which a text is ``rejected`` as none of the learned languages.

Letters are lower-cased; everything else counts as one space. Null text and text without a letter give ``und`` and
score 0. Repeated rows each get a result. Without any labelled row all is ``und``. Ties go to the first name. Further
columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, logistic, slices

SAMPLE_PER_LANGUAGE = 300
ORDER = 4
DISCOUNT = 0.75
FOLDS = 3
#: Share of calibration texts whose cross-entropy is accepted, and the slack beyond it.
ACCEPT, SLACK = 0.995, 1.25

_MULT = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(31)
_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x3000)), bool, 0x3000)


def symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, runs of anything else as one space, a space at either end."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = np.ones(len(code), bool)
    low = code < len(_LETTER)
    letter[low] = _LETTER[code[low]]
    if not low.all():
        high, at = np.unique(code[~low], return_inverse=True)
        letter[~low] = np.fromiter((chr(c).isalpha() for c in high), bool, len(high))[at]
    kept = np.where(letter, code, 32)
    kept = np.concatenate(([32], kept, [32]))
    return kept[np.concatenate(([True], (kept[1:] != 32) | (kept[:-1] != 32)))].astype(np.uint64)


def grams(s: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` symbols that end at each place from ``n - 1`` on."""
    h = s[: len(s) - n + 1] + np.uint64(1)
    for i in range(1, n):
        h = (h ^ (h >> _SHIFT)) * _MULT + s[i : len(s) - n + 1 + i] + np.uint64(1)
    return h


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    langs: list[str]
    keys: list[np.ndarray]  # by order, 1 first
    logp: list[np.ndarray]  # (n-grams, languages)
    contexts: list[np.ndarray]  # of order 2 and up; index 0 is unused
    backoff: list[np.ndarray]
    unseen: float
    slope: float = 20.0
    offset: float = 0.0
    limit: np.ndarray | None = None

    def entropies(self, s: np.ndarray) -> np.ndarray:
        """Cross-entropy per character by language, in nats."""
        total = np.zeros(len(self.langs))
        count = len(s) - 1
        top = min(ORDER, len(s))
        for n in range(2, top):  # the first characters have shorter histories
            total += self._sum(grams(s[:n], n), s, np.array([n - 1]), n)
        total += self._sum(grams(s, top), s, np.arange(top - 1, len(s)), top)
        return -total / max(count, 1)

    def _sum(self, h: np.ndarray, s: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
        at, hit = _find(self.keys[n - 1], h)
        total = self.logp[n - 1][at[hit]].sum(0, dtype=np.float64)
        missed = ends[~hit]
        if len(missed):
            if n == 1:
                return total + len(missed) * self.unseen
            ctx = np.zeros(len(missed), np.uint64)
            short = np.zeros(len(missed), np.uint64)
            for i in range(n - 1):
                c, d = s[missed - n + 1 + i] + np.uint64(1), s[missed - n + 2 + i] + np.uint64(1)
                ctx = c if i == 0 else (ctx ^ (ctx >> _SHIFT)) * _MULT + c
                short = d if i == 0 else (short ^ (short >> _SHIFT)) * _MULT + d
            at, hit = _find(self.contexts[n - 1], ctx)
            total = total + self.backoff[n - 1][at[hit]].sum(0, dtype=np.float64)
            total = total + self._sum(short, s, missed, n - 1)
        return total

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language or und, score, rejected)."""
        if not text or not self.langs:
            return "und", 0.0, True
        s = symbols(text)
        if len(s) < 3:
            return "und", 0.0, True
        h = self.entropies(s)
        best = int(np.argmin(h))
        second = np.partition(h, 1)[1] if len(h) > 1 else h[best] + 1
        lead = (second - h[best]) * np.sqrt(min(len(s), 400) / 400)
        score = float(1 / (1 + np.exp(-np.clip(self.slope * lead + self.offset, -30, 30))))
        return self.langs[best], score, bool(self.limit is not None and h[best] > self.limit[best])


def fit(texts: dict[str, list[str]]) -> Model:
    """Counts, discounts and interpolates; ``texts`` by language."""
    langs = sorted(texts)
    raw: list[list[np.ndarray]] = [[] for _ in langs]
    for i, lang in enumerate(langs):
        raw[i] = [x for x in (symbols(t) for t in texts[lang]) if len(x) >= 3]
    langs, raw = [x for x, r in zip(langs, raw, strict=True) if r], [r for r in raw if r]
    if not langs:
        return Model([], [], [], [], [], 0.0)
    # By language and order: distinct n-grams with the hash of their context and suffix, and their count.
    tables: list[list[tuple]] = []
    for docs in raw:
        own = {}
        for n in range(1, ORDER + 1):
            long = [d for d in docs if len(d) >= n]
            key = np.concatenate([grams(d, n) for d in long]) if long else np.empty(0, np.uint64)
            ctx = np.concatenate([grams(d[:-1], n - 1) if n > 1 else np.zeros(len(d), np.uint64) for d in long]) if long else key
            suf = np.concatenate([grams(d[1:], n - 1) if n > 1 else np.zeros(len(d), np.uint64) for d in long]) if long else key
            uniq, first, count = np.unique(key, return_index=True, return_counts=True)
            own[n] = [uniq, ctx[first], suf[first], count.astype(np.float64)]
        for n in range(1, ORDER):  # lower orders count in how many contexts an n-gram continues
            uniq, count = np.unique(own[n + 1][2], return_counts=True)
            at, hit = _find(own[n][0], uniq)
            fresh = np.zeros(len(own[n][0]))
            fresh[at[hit]] = count[hit]
            own[n][3] = np.maximum(fresh, 1.0)
        tables.append([own[n] for n in range(1, ORDER + 1)])
    keys, logp, contexts, backoff = [], [], [], []
    probs: np.ndarray | None = None
    alphabet = len(np.unique(np.concatenate([t[0][0] for t in tables]))) + 1
    for n in range(1, ORDER + 1):
        stacked = [np.concatenate([t[n - 1][j] for t in tables]) for j in range(3)]
        uniq, first = np.unique(stacked[0], return_index=True)
        ctx, suf = stacked[1][first], stacked[2][first]
        ckeys = np.unique(ctx)
        lower = np.full((len(uniq), len(langs)), 1.0 / alphabet) if n == 1 else probs[_find(keys[-1], suf)[0]]
        gamma = np.ones((len(ckeys), len(langs)))
        p = np.empty((len(uniq), len(langs)))
        for j, t in enumerate(tables):
            k, c, _, count = t[n - 1]
            ci = np.searchsorted(ckeys, c)
            total = np.bincount(ci, count, len(ckeys))
            kinds = np.bincount(ci, minlength=len(ckeys))
            seen = total > 0
            gamma[seen, j] = DISCOUNT * kinds[seen] / total[seen]
            mass = np.zeros(len(uniq))
            at = np.searchsorted(uniq, k)
            mass[at] = np.maximum(count - DISCOUNT, 0) / total[ci]
            p[:, j] = mass + gamma[np.searchsorted(ckeys, ctx), j] * lower[:, j]
        keys.append(uniq)
        logp.append(np.log(p).astype(np.float32))
        contexts.append(ckeys)
        backoff.append(np.log(gamma).astype(np.float32))
        probs = p
    return Model(langs, keys, logp, contexts, backoff, float(np.log(DISCOUNT / alphabet)))


def calibrate(model: Model, texts: dict[str, list[str]]) -> Model:
    """Logistic fit of right or wrong on the lead, and the rejection limits."""
    lead, right, own = [], [], [[] for _ in model.langs]
    for lang, rows in texts.items():
        for t in rows:
            s = symbols(t)
            if len(s) < 3 or not model.langs:
                continue
            h = model.entropies(s)
            best = int(np.argmin(h))
            second = np.partition(h, 1)[1] if len(h) > 1 else h[best] + 1
            lead.append((second - h[best]) * np.sqrt(min(len(s), 400) / 400))
            right.append(model.langs[best] == lang)
            if lang in model.langs:
                own[model.langs.index(lang)].append(h[model.langs.index(lang)])
    if not lead:
        return model
    x, y = np.array(lead), np.array(right, float)
    a, b = logistic(x, y, slope=20.0)
    model.slope, model.offset = max(float(a), 0.0), float(b)
    model.limit = np.array([np.quantile(h, ACCEPT) * SLACK if h else np.inf for h in own])
    return model


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", may_learn: Column | None = None) -> Model:
    """Fit and calibrate on a bounded sample of the labelled rows for which ``may_learn`` holds."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = known.filter(may_learn) if may_learn is not None else known
    sizes = {r[lang]: r["n"] for r in known.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return fit({})
    want = 2 * SAMPLE_PER_LANGUAGE
    share = F.coalesce(*(F.when(F.col(lang) == k, F.lit(min(1.0, want / n))) for k, n in sorted(sizes.items())))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1_000_003)) / 1_000_003
    got = known.filter(draw <= share).select("doc_id", draw.alias("draw"), F.col(lang).alias("lang"), F.col(text).alias("text")).collect()
    rows: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r["draw"], str(r["doc_id"]), r["text"])):
        own = rows.setdefault(r["lang"], [])
        if len(own) < SAMPLE_PER_LANGUAGE:
            own.append(r["text"])
    learn = {k: [t for i, t in enumerate(v) if i % 5 or len(v) < 5] for k, v in rows.items()}
    check = {k: [t for i, t in enumerate(v) if not i % 5] for k, v in rows.items()}
    return calibrate(fit(learn), check)


def predict(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected``: learns from ids whose crc32 modulo ``FOLDS`` isn't 1."""
    model = train(docs, text=text, lang=lang, may_learn=fold(F.col("doc_id"), FOLDS) != 1)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in slices(batches, 1024):
            got = [own.predict(t) for t in b.column("body").to_pylist()]
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *cols], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 1).alias("held_out"), F.col(text).alias("body"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
