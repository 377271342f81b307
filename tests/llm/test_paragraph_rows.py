"""Paragraph rows against all pairs, wrapped text, and odd ids."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkstrata.llm import bagminhash, paragraphs

SCHEMA = "doc_id long, text string"


def _words(rng, n):
    return ["".join(rng.choice("aeioubcdt") for _ in range(rng.randint(3, 7))) for _ in range(n)]


def _family(rng, lines, words, changes):
    """Lines on one template: neighbours in a family differ in more or fewer words."""
    base = _words(rng, words)
    out = []
    for k in range(lines):
        line = list(base if k % 3 else out[-1] if out else base)
        for at in rng.sample(range(words), changes[k % len(changes)]):
            line[at] = f"x{rng.randrange(10**6)}"
        out.append(line)
    return [" ".join(line) for line in out]


def _paragraph_rows(texts):
    """Every row by its definition: exact sets of five-word runs, all pairs."""
    units = []
    for i, t in enumerate(texts):
        at = 0
        for line in t.split("\n"):
            words = line.split()
            if len(words) >= paragraphs.MIN_WORDS:
                units.append((i, at, at + len(line), words, {tuple(words[k : k + 5]) for k in range(len(words) - 4)}))
            at += len(line) + 1
    root = list(range(len(units)))
    for a in range(len(units)):
        for b in range(a):
            x, y = units[a][4], units[b][4]
            if len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    rows = set()
    for k, (i, start, end, words, _) in enumerate(units):
        if root.count(root[k]) > 1:
            rows.add((i, start, end, len(words), units[root[k]][0], k == root[k]))
    return rows


@pytest.mark.parametrize("block", [256, 8])
def test_rows_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(bagminhash, "BLOCK", block)
    rng = random.Random(21)
    lines = _family(rng, 90, 60, (1, 2, 3)) + _family(rng, 40, 25, (1,)) + [" ".join(_words(rng, 30)) for _ in range(40)]
    lines += lines[:5]
    rng.shuffle(lines)
    texts = ["\n".join(lines[k : k + 5]) for k in range(0, len(lines), 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {(r.doc_id, r.start, r.end, r.n_words, r.class_id, r.keep) for r in paragraphs.repeats(docs).collect() if r.kind == "paragraph"}
    assert got == _paragraph_rows(texts)


def test_recall_on_the_table(spark):
    """No two similar paragraphs of the table are in different classes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    narrow = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body")).withColumn("mark", F.xxhash64("body"))
    units = paragraphs.written(paragraphs._units(narrow), "units")
    root = {r.node: r.root for r in paragraphs.roots_of(narrow, units).collect()}
    bodies = {}
    for r in narrow.collect():
        h, _, _, line = paragraphs.cut(r.body)
        first, last = paragraphs.lines_of(h, line)
        for node, a, b in zip(paragraphs.sums(h, first, last).view(np.int64), first, last, strict=True):
            bodies.setdefault(int(node), paragraphs._set(h[a:b].astype(np.uint32).tobytes()))
    holders, shared = {}, {}
    for node, bag in bodies.items():
        for e in bag.tolist():
            for other in holders.setdefault(e, []):
                shared[other, node] = shared.get((other, node), 0) + 1
            holders[e].append(node)
    near = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(bodies[a]) + len(bodies[b]) - n)]
    assert len(near) > 40
    assert all(root.get(a, a) == root.get(b, b) for a, b in near)


def test_wrapped_lines_are_one_paragraph(spark):
    rng = random.Random(22)
    words = _words(rng, 64)  # one word edited leaves 55 of 65 runs of five
    edited = list(words)
    edited[30] = "other"
    wrap = lambda w: "\n".join(" ".join(w[k : k + 8]) for k in range(0, len(w), 8))
    texts = [" ".join(_words(rng, 25)) + "\n\n" + wrap(words) + "\n\n" + wrap(_words(rng, 40)), wrap(edited)]
    rows = [r for r in paragraphs.repeats(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect() if r.kind == "paragraph"]
    assert {(r.doc_id, r.n_words, r.class_id, r.keep) for r in rows} == {(0, 64, 0, True), (1, 64, 0, False)}
    assert paragraphs.paragraphs_of(np.array([0] * 30 + [1, 1, 2, 4, 5, 5])).tolist() == [0] * 30 + [1, 1, 1, 4, 4, 4]


@pytest.mark.parametrize("ids", [(None, None), (None, 4), (4, 4), (4, 9)])
def test_null_and_repeated_ids(spark, ids):
    rng = random.Random(23)
    passage, line = " ".join(_words(rng, 80)), " ".join(_words(rng, 40))
    texts = [" ".join(_words(rng, 30)) + " " + passage + "\n" + line, " ".join(_words(rng, 20)) + " " + passage + "\n" + line]
    rows = list(zip(ids, texts, strict=True))
    got = paragraphs.repeats(spark.createDataFrame(rows + rows[:1], SCHEMA)).collect()  # a repeated row counts once for passages
    by = {}
    for r in got:
        by.setdefault((r.kind, r.text_hash), []).append(r)
    assert len(by) == 4
    for kind in ("paragraph", "passage"):
        own = [[r.keep for r in rs] for (k, _), rs in by.items() if k == kind]
        assert sorted(any(x) for x in own) == [False, True]
        assert {r.class_id for (k, _), rs in by.items() if k == kind for r in rs} == {ids[0]}


def test_colliding_hashes_lose_no_document(spark, monkeypatch):
    real = bagminhash.node_of
    monkeypatch.setattr(bagminhash, "node_of", lambda t, w: (1 if "same" in (t or "") else real(t, w)[0], real(t, w)[1]))
    texts = ["same one two three", "same four five six", "other", "same one two three"]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumn("kept_mark", F.lit(1))
    # Only the driver's copy is changed, so the clash is made by hand.
    signed = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.when(F.col("text").contains("same"), 1).otherwise(2).cast("long").alias("node"), F.xxhash64("text").alias("check"), F.lit(0).cast("long").alias("n"), F.array().cast("array<long>").alias("bands"), F.array().cast("array<tinyint>").alias("sketch"))
    monkeypatch.setattr(bagminhash, "_signed", lambda narrow: signed)
    kept = bagminhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2]
