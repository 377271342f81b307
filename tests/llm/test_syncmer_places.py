"""Anchors under inserts in any script, likeness and order against brute force, positions of shared runs."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sparkstrata.llm import syncmers

SCHEMA = "doc_id long, text string"
RNG = random.Random(41)
TEXTS = {
    "chinese": "".join(chr(RNG.randrange(0x4E00, 0x9000)) for _ in range(3000)),
    "hex": "".join(RNG.choice("0123456789abcdef") for _ in range(3000)),
    "base64": "".join(RNG.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(3000)),
    "code": "".join(f"x{RNG.randrange(99)} = f_{RNG.randrange(99)}(a[{RNG.randrange(9)}], b);\n" for _ in range(120)),
    "russian": " ".join("".join(chr(RNG.randrange(0x430, 0x450)) for _ in range(RNG.randrange(3, 9))) for _ in range(500)),
    "prose": " ".join("".join(RNG.choice("etaoinshrdlu") for _ in range(RNG.randrange(2, 9))) for _ in range(600)),
}


def _anchors(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return {r.doc_id: [(a.at, a.hash) for a in r.found] for r in df.select("doc_id", syncmers.anchors(F.col("text")).alias("found")).collect()}


@pytest.mark.parametrize("kind", sorted(TEXTS))
def test_one_insert_keeps_the_anchors(spark, kind):
    text = TEXTS[kind]
    texts = [text, "好" + text, "q" + text, "7" + text, " " + text, text[:1500] + "z" + text[1500:]]
    found = _anchors(spark, texts)
    own = {h for _, h in found[0]}
    assert len(own) > 100
    for i in range(1, len(texts)):
        assert len(own & {h for _, h in found[i]}) > 0.95 * len(own)


def _brute(spark, rows):
    """Order, edited text, sets and likeness of every row by the definition."""
    mark = {r.text: r.mark for r in spark.createDataFrame([(t or "",) for _, t in rows], "text string").select("text", F.xxhash64("text").alias("mark")).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, mark[r[1]]), reverse=True)
    edited = []
    for k, (_, t) in enumerate(order):
        then = order[(k + 1) % len(order)][1]
        edited.append(t[: len(t) - len(t) // 2] + then[: len(t) // 2])
    own = _anchors(spark, [t for _, t in order])
    new = _anchors(spark, edited)
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
    sets = lambda f: {k: {h for _, h in v} for k, v in f.items()}
    own, new = sets(own), sets(new)
    n = len(order)
    return sorted((str(i), hashlib.sha256(e.encode()).hexdigest(), round(dice(own[k], new[k]), 9), round(dice(own[k], own[(k + 1) % n]), 9)) for k, ((i, _), e) in enumerate(zip(order, edited, strict=True)))


@pytest.mark.parametrize("range_rows", [500, 3])
def test_rows_are_those_of_the_definition(spark, monkeypatch, range_rows):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", range_rows)
    rng = random.Random(42)
    text = lambda: "".join(rng.choice("abc de, é𐍈日\n0") for _ in range(rng.randint(0, 120)))
    rows = [(i, text()) for i in range(40)] + [(7, text()) for _ in range(30)] + [(None, text()) for _ in range(30)] + [(50, None), (51, ""), (2**63 - 1, "last")] + [(9, "same")] * 4
    rng.shuffle(rows)
    got = syncmers.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == _brute(spark, rows)


def test_hot_ids_are_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 10)
    ids = spark.createDataFrame([(i,) for i in list(range(100)) + [55] * 300 + [None] * 200], "doc_id long")
    ranges = syncmers._Ranges(ids)
    rows = ids.withColumn("mark", F.xxhash64(F.monotonically_increasing_id())).withColumn("part", ranges.of(F.col("doc_id"), F.col("mark")))
    assert rows.groupBy("part").count().agg(F.max("count")).first()[0] < 60


def test_any_change_of_an_anchor_shows(spark):
    """The sketch alone would miss most changes of a long text."""
    rng = random.Random(43)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(6000)]
    texts = [" ".join(words)]
    for _ in range(12):
        changed = list(words)
        changed[rng.randrange(6000)] = "qqqq" + str(rng.randrange(1000))
        texts.append(" ".join(changed))
    got = [r.f for r in spark.createDataFrame([(t,) for t in texts], "text string").select(syncmers.fingerprint(F.col("text")).alias("f")).collect()]
    assert len(set(got)) == 13


def test_shared_runs_by_position(spark):
    passage = TEXTS["prose"][:800]
    texts = [passage, TEXTS["code"][:400] + passage + TEXTS["code"][:300], TEXTS["russian"]]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    rows = syncmers.shared_runs(docs, spark.createDataFrame([(0, 1), (0, 2)], "a long, b long")).collect()
    best = max(rows, key=lambda r: r.n_anchors)
    assert (best.a, best.b) == (0, 1) and best.n_anchors > 50 and all(r.b == 1 for r in rows)
    symbols = spark.createDataFrame([(TEXTS["code"][:400],)], "t string").select(F.size(syncmers.symbols(F.col("t")))).first()[0]
    assert abs(best.shift - symbols) <= 2
