"""Whole results of op2 and op6 against plain versions, and the pipeline on an empty table."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from sparkstrata.llm import decontam, token_counts


def _plain_alignment(a, b):
    """Best local score by the full table."""
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return int(h.max())


def test_leaks_against_all_alignments(spark):
    rng = random.Random(51)
    word = lambda: "".join(rng.choice("aeioubcdt") for _ in range(rng.randint(4, 8)))
    items = [[word() for _ in range(rng.randint(10, 24))] for _ in range(6)]
    texts = []
    for i in range(48):
        own = [word() for _ in range(rng.randint(5, 60))]
        if i % 2:
            part = list(items[i % 6])
            for _ in range(rng.choice((0, 1, 2, 6))):
                part[rng.randrange(len(part))] = word()
            if i % 5 == 0:
                del part[len(part) // 2]
            own += part[: rng.choice((len(part), len(part), len(part) // 3))] + [word() for _ in range(20)]
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.leaks(docs, bench).collect()}
    want = {}
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            score = _plain_alignment(item, t.split()) / (2 * len(item))
            if score >= decontam.THRESHOLD:
                want[i, k] = score
    assert set(got) == set(want) and len(want) > 10
    assert all(got[p] == pytest.approx(want[p]) for p in want)


def _plain_counts(encoder, fields):
    """Every byte's section by looking it up, every token's section by counting its bytes."""
    text = "\n".join(fields)
    sections, owner = [], []
    for k, f in enumerate(fields[:-1]):
        sections.append((k, 0))
        owner += [len(sections) - 1] * len((f + "\n").encode())
    lines = fields[-1].split("\n")
    for j, line in enumerate(lines):
        sections.append((len(fields) - 1, j))
        owner += [len(sections) - 1] * len((line + ("\n" if j < len(lines) - 1 else "")).encode())
    tokens, shares, at = [0] * len(sections), [0.0] * len(sections), 0
    for token in encoder.encoding.encode_ordinary(text):
        held = owner[at : at + len(encoder.encoding.decode_single_token_bytes(token))]
        at += len(held)
        tokens[max(set(held), key=lambda s: (held.count(s), -s))] += 1
        for s in held:
            shares[s] += 1 / len(held)
    assert at == len(text.encode())
    return {s: (n, x) for s, n, x in zip(sections, tokens, shares, strict=True)}


def test_counts_of_every_section_against_bytes(spark):
    rng = random.Random(52)
    texts = ["".join(rng.choice(["the ", "ing", "\n", "\n\n", "é", "日本", " ", "123", ".", "𐍈", "word"]) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "\n", "a\n"]
    rows = [(i, t, rng.choice(["en", "", None]), rng.choice(["web", "x\ny", None])) for i, t in enumerate(texts)]
    got = token_counts.counted(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    with open(token_counts.RANKS_PATH, "rb") as f:
        encoder = token_counts.Encoder(f.read())
    names = ("source", "lang", "text")
    want = {}
    for i, t, lang, source in rows:
        for (k, j), v in _plain_counts(encoder, [source or "", lang or "", t or ""]).items():
            want[i, names[k], j] = v
    assert {(r.doc_id, r.field, r.section) for r in got} == set(want)
    for r in got:
        n, share = want[r.doc_id, r.field, r.section]
        assert r.n_tokens == n and r.share == pytest.approx(share)


def test_pipeline_of_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    for name, rows in (("none", []), ("odd", [(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0), (2, "x" * 5000, "en", "s", 5000), (3, "password=abcdef", None, None, None)])):
        folder = tmp_path / name
        spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
        labels.write.parquet(str(folder / "labels.parquet"))
        bench.write.parquet(str(folder / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(folder)).collect()
        # Null text and empty text are copies of each other, and the null id is the least.
        assert sorted(str(r.doc_id) for r in out) == ([] if name == "none" else ["2", "3", "None"])
