"""Revealing terms against counts made by hand, sanitised texts, and very long inputs."""

from __future__ import annotations

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sparkstrata.llm import pii, spans

SCHEMA = "doc_id long, text string"


def _brute(texts):
    """(doc, start, end, kind) of every added span, from the definition."""
    base, entities, terms, whole = [], [], [], []
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for t in texts:
        own = [(m.start(), m.end(), k, m[0]) for k, p in patterns.items() for m in re.finditer(p, t)]
        base.append(own)
        entities.append({(k, v.lower() if k == "email" else re.sub("[^0-9]", "", v)) for _, _, k, v in own})
        clear = "".join("\n" if any(a <= i < b for a, b, _, _ in own) else c for i, c in enumerate(t))
        terms.append({w.lower() for w in re.findall(r"[^\W\d_]{2,}", clear)})
        whole.append({w.lower() for w in re.findall(r"[^\W\d_]{2,}", t)})
    n = len(texts)
    out = set()
    for i, t in enumerate(texts):
        worst = {}
        for e in entities[i]:
            df_e = sum(e in x for x in entities)
            if df_e < pii.SUPPORT or df_e > n / 2**pii.MIN_BITS:
                continue
            for w in terms[i]:
                df_te = sum(e in x and w in y for x, y in zip(entities, terms, strict=True))
                if df_te < pii.SUPPORT or df_te * math.log(n / df_e) < pii.EVIDENCE:
                    continue
                df_t = sum(w in x for x in whole)
                worst[w] = max(worst.get(w, 0), 1 - math.log(df_te / max(df_t, df_te)) / math.log(df_e / n))
        for m in re.finditer(r"[^\W\d_]{2,}", t):
            d = worst.get(m[0].lower(), 0)
            if d >= pii.GENERALISE and not any(a < m.end() and m.start() < b for a, b, _, _ in base[i]):
                out.add((i, m.start(), m.end(), "remove" if d >= pii.REMOVE else "generalise"))
    return out


def _corpus(seed):
    rng = random.Random(seed)
    common = [f"{a}{b}" for a in ("ba", "co", "du", "fe") for b in ("lan", "mer", "nos", "pit")]
    names = ["Zorblax", "Quimby", "Ivanka", "Li"]
    texts = []
    for i in range(240):
        words = [rng.choice(common) for _ in range(rng.randint(5, 40))]
        for k, name in enumerate(names):
            if rng.random() < 0.03:
                words.insert(0, f"user{k}@mail.org")
                if rng.random() < 0.97:
                    words += [name] + [rng.choice(common) for _ in range(30)] + [name.upper()]  # far off, and again
            if rng.random() < 0.005 * (k % 2):
                words.append(name)
        if rng.random() < 0.5:
            words.append("call +1 202 555 0100")  # common knowledge
        if i % 40 == 0:
            words.append("+44 20 7946 0958 Zorblax")
        texts.append(" ".join(words) + f". {i}")
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_added_spans_are_those_of_the_definition(spark, seed):
    texts = _corpus(seed)
    rows = pii.sanitise(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    got = {(r.doc_id, a.start, a.end, a.kind) for r in rows for a in r.added}
    want = _brute(texts)
    assert got == want and len(want) > 10


def test_a_common_entity_hides_no_rare_one(spark):
    texts = [f"zorblax writes to jane@corp.org, {'call +1 202 555 0100' if i else 'no call'} x{i}" for i in range(4)]
    texts += [f"please call +1 202 555 0100 today {i}" for i in range(60)] + [f"nothing here {i}" for i in range(60)]
    rows = pii.sanitise(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).orderBy("doc_id").collect()
    assert all(any(a.value == "zorblax" and a.kind == "remove" for a in r.added) for r in rows[:4])
    assert all(not r.added for r in rows[4:])


def test_sanitised_texts(spark):
    texts = [f"Zorblax met jane@corp.org at noon. {'far ' * 60} zorblax left {i}" for i in range(4)] + [f"we met at noon, far off, and left {i}" for i in range(200)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA + ", span_list string")
    out = pii.sanitised(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    for i in range(4):
        assert got[i] == f" met [email] at noon. {'far ' * 60}  left {i}"
    assert all(got[i] == t for i, t in enumerate(texts) if i >= 4)


def test_running_sums(spark):
    sizes = [[], [3], list(range(200)), [1] * 1000, [0] * 64, [2] * 65]
    rows = spark.createDataFrame([(s,) for s in sizes], "a array<int>").select("a", spans.running(F.col("a")).alias("r")).collect()
    for r in rows:
        want, total = [], 0
        for x in r.a:
            want.append(total)
            total += x
        assert r.r == [*want, total]


def test_very_long_texts(spark):
    """Long runs of digits, of @, of lines and of matches take time that grows about with the length."""
    long = ["1" * 400_000, "@" * 400_000, "a@b.c\n" * 10_000, "+1 2" * 60_000, "x\n" * 200_000, "7 " * 200_000, "password=abcdef\n" * 5_000]
    at = time.time()
    rows = pii.digest(pii.sanitise(spark.createDataFrame(list(enumerate(long)), SCHEMA))).orderBy("doc_id").collect()
    assert rows[2].n_email == 10_000 and rows[1].n_email == 0
    assert time.time() - at < 120
