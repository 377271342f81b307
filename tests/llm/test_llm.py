"""The ten operators and the pipeline: brute force, round trips, and the odd cases of every input."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkstrata.llm import bagminhash, components, decontam, langid, paragraphs, pieces, pii, secrets, syncmers, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en"):
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " ", "word", "word", "a@b.c " * 3, "x" * 20_000, "\n\n", "日本語 テキスト 𐍈", None]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""
    df = documents(spark, ODD)
    df = df.unionByName(df.filter("doc_id = 3")).unionByName(spark.createDataFrame([(None, "no id", None, None, None)], SCHEMA))
    return df.withColumns({"body": F.lit("clash"), "node": F.lit(1), "spans": F.lit(None).cast("string"), "mark": F.lit(2), "score": F.lit(0.5)})


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        x = int(c) * (1 + i % 2)
        t += x - 9 * (x > 9)
    return t % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15),
}
SECRETS = {
    "assign": (r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def base(text, kinds):
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text or "") if ok(m)]
    return hashlib.sha256(",".join(x[2] for x in sorted(found)).encode()).hexdigest(), len(found)


def soup(parts, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_pii_matches_plain_patterns(spark):
    parts = ["a@b.c", "x.y+z@", "@", "d@e", ".f_g@h.i", "1.2.3.4", ".5", "256.1.1.1", "4111 1111 1111 1111", "411", "-1111", "+1 (202) 555-0123", "+", " ", "é", "\n", "𐍈", "7"]
    docs = documents(spark, soup(parts, 300, 1) + ODD)
    for r, text in zip(pii.digest(pii.sanitise(docs)).orderBy("doc_id").collect(), soup(parts, 300, 1) + ODD, strict=True):
        sha, n = base(text, PII)
        assert (r.base_sha256, r.n_email + r.n_ip + r.n_card + r.n_phone) == (sha, n)


def test_pii_marks_terms_that_reveal(spark):
    texts = [f"call zorblax at jane@corp.org now {i}" for i in range(3)] + [f"call me now please {i}" for i in range(60)]
    rows = pii.digest(pii.sanitise(documents(spark, texts))).orderBy("doc_id").collect()
    assert all(re.search(r"remove:5:12", r.spans) and "email:16:29" in r.spans for r in rows[:3])
    assert all(r.spans == "" for r in rows[3:])


def test_secrets_match_plain_patterns(spark):
    parts = ["password", "token", "API_KEY", "secret", '"', " ", ":", "=", "abc123", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "g", "é", "'", "passwd: hunter22"]
    texts = soup(parts, 300, 2) + ODD
    for r, text in zip(secrets.digest(secrets.scan(documents(spark, texts))[0]).orderBy("doc_id").collect(), texts, strict=True):
        sha, n = base(text, SECRETS)
        assert (r.base_sha256, r.n_assign + r.n_access + r.n_hex) == (sha, n)


def test_ledger_scans_only_unseen(spark):
    docs = documents(spark, ["password=abcdef", "password=abcdef", "clean", "token: zzzzzzz"])
    found, ledger = secrets.scan(docs)
    assert ledger.count() == 3 and found.count() == 4
    ledger = ledger.checkpoint()
    again, new = secrets.scan(docs, ledger=ledger)
    assert new.count() == 0
    assert sorted(map(str, secrets.digest(again).collect())) == sorted(map(str, secrets.digest(found).collect()))
    old = ledger.withColumn("rule_version", F.lit("old"))
    assert secrets.scan(docs, ledger=old)[1].count() == 3


def test_redaction(spark):
    docs = documents(spark, ["x password=abcdef y", "clean", None])
    assert [(r.text, r.n_chars) for r in secrets.redacted(docs).orderBy("doc_id").collect()] == [("x [secret] y", 12), ("clean", 5), (None, None)]


def test_leaks_exact_edited_and_clean(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioubcdt") for _ in range(rng.randint(3, 7)))
    item = [word() for _ in range(40)]
    edited = [word() if i % 7 == 6 else w for i, w in enumerate(item)]
    noise = lambda n: " ".join(word() for _ in range(n))
    texts = [noise(50) + " " + " ".join(item).upper() + ". " + noise(20), noise(9) + "\n" + " ".join(edited) + noise(30), noise(100), " ".join(item[:6]) + noise(60)]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, ""), (9, None)], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontam.leaks(documents(spark, texts + ODD), bench).collect()}
    assert set(got) == {0, 1} and got[0] == 1.0 and 0.45 <= got[1] < 1
    assert sorted(r.doc_id for r in decontam.without_leaks(documents(spark, texts), bench).collect()) == [2, 3]


def test_alignment_against_full_table():
    rng = np.random.default_rng(4)
    for _ in range(40):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(1, 12))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontam.align(a, b)[0] == h.max()


def test_toxicity_learns_and_survives(spark, odd, empty):
    rng = random.Random(5)
    common = ["tree", "house", "river", "stone", "bread", "light", "cloud"]
    texts = [" ".join(rng.choice(common) for _ in range(30)) + (" vileword" if i % 4 == 0 else "") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.predict(documents(spark, texts), labels).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 400 and 40 < len(held) < 120
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.97
    assert toxicity.predict(odd, labels).count() == odd.count()
    assert toxicity.predict(empty, labels).count() == 0
    none = toxicity.predict(odd, labels.limit(0)).collect()
    assert all(r.score < 1e-6 for r in none)


def test_language_models(spark, odd, empty):
    en, de = "the and ing tion that with ".split(), "der die ung schen nicht und ".split()
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(en if i % 2 else de) for _ in range(20)), "en" if i % 2 else "de", "s", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = langid.predict(docs).collect()
    assert len(got) == 200 and all(r.lang_pred == ("en" if r.doc_id % 2 else "de") and 0 <= r.score <= 1 for r in got)
    assert any(r.held_out for r in got)
    out = {r.doc_id: r for r in langid.predict(docs.unionByName(documents(spark, [None, "123 !!"]).withColumn("doc_id", F.col("doc_id") + 1000))).collect()}
    assert out[1000].lang_pred == out[1001].lang_pred == "und" and out[1000].score == 0
    assert langid.predict(odd).count() == odd.count()
    assert langid.predict(empty).count() == 0


def test_kneser_ney_sums_to_one():
    model = langid.fit({"a": ["abcab abd", "abba cab"], "b": ["bbb dada", "dab bad"]})
    text = langid.symbols("abcab")
    for j in range(2):  # over the alphabet the probabilities of the next symbol sum to 1, up to the unseen symbol's share
        total = 0.0
        for k in model.keys[0]:
            s = np.append(text[:4], k - np.uint64(1))
            total += np.exp(model._sum(langid.grams(s, 4)[-1:], s, np.array([len(s) - 1]), 4)[j])
        assert 0.8 < total <= 1.0001


def test_pieces_equal_the_library(spark, odd, empty):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    own = pieces.Transducer(pieces._model(pieces.MODEL_PATH))
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab the\n\té日𐍈.,  eringtion01") for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["a" * 300, " " * 50, "", "\n" * 9, "==== ---- ...."]
    for t in texts:
        ids = own.encode(t)
        assert ids == sp.encode(t)
        assert own.decode(ids) == t
    rows = pieces.encoded(odd).collect()
    assert len(rows) == odd.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    back = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(documents(spark, ODD))).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    assert pieces.encoded(empty).count() == 0


def test_unigram_shortest_path():
    def field(tag, body):
        return bytes([tag << 3 | 2, len(body)]) + body

    import struct

    def piece(p, score, kind=1):
        return field(1, field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, kind]))

    model = piece("<unk>", 0, 2) + piece("ab", -1.0) + piece("a", -1.5) + piece("b", -1.5) + piece("abc", -5.0) + piece("c", -1.0) + field(2, bytes([3 << 3, 1])) + field(3, bytes([3 << 3, 0, 4 << 3, 0]))
    own = pieces.Transducer(model)
    assert [own.pieces[i] for i in own.encode("abc")] == ["ab", "c"]
    assert own.encode("x") == [0]


def test_token_counts_cover_and_allocate(spark, odd, empty):
    rows = token_counts.counted(odd).collect()
    assert sum(r.n_tokens for r in rows) == pytest.approx(sum(r.share for r in rows))
    assert token_counts.counted(empty).count() == 0
    counts, shares = token_counts.attribute(np.array([2, 3, 1]), np.array([0, 3, 3, 6]), "most")
    assert counts.tolist() == [1, 0, 2] and shares.tolist() == pytest.approx([1 + 1 / 3, 0, 2 / 3 + 1])
    assert token_counts.attribute(np.array([2, 3, 1]), np.array([0, 3, 3, 6]), "first")[0].tolist() == [2, 0, 1]
    with open(token_counts.RANKS_PATH, "rb") as f:
        enc = token_counts.Encoder(f.read())
    for t in ("a" + " " * 12_000 + "b", " " * 7000, "x\n" * 3000 + "\n" * 6000 + "end", "plain text"):
        assert b"".join(enc.encoding.decode_single_token_bytes(i) for i in enc.encode(t)) == t.encode()
    for t in ("a" + " " * 5200 + "b c", "\n" * 5001, "end " + "\t" * 5500):
        assert enc.encode(t) == enc.encoding.encode_ordinary(t)


def _edited(texts):
    order = list(range(len(texts) - 1, -1, -1))
    nxt = dict(zip(order, order[1:] + order[:1], strict=True))
    return {i: (t or "")[: len(t or "") - len(t or "") // 2] + (texts[nxt[i]] or "")[: len(t or "") // 2] for i, t in enumerate(texts)}


def test_syncmers_of_edited_texts(spark, odd, empty):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc de, é𐍈\n") for _ in range(rng.randint(0, 400))) for _ in range(60)] + ODD
    got = {r.doc_id: r for r in syncmers.fingerprints(documents(spark, texts)).collect()}
    want = _edited(texts)
    direct = spark.createDataFrame(list(want.items()), "doc_id long, text string").select("doc_id", syncmers.fingerprint(F.col("text")).alias("f"))
    for r in direct.collect():
        own = got[r.doc_id]
        assert own.edited_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert own.edited_fingerprint == r.f and own.n_chars == len(texts[r.doc_id] or "")
        assert 0 <= own.near_edited <= 1 and 0 <= own.near_next <= 1
    assert got[63].fingerprint == got[64].fingerprint  # equal texts
    assert syncmers.fingerprints(odd).count() == odd.count()
    assert syncmers.fingerprints(empty).count() == 0


def test_syncmer_condition(spark):
    text = "The quick brown fox jumps over the lazy dog, twice and again."
    df = spark.createDataFrame([(text,)], "t string")
    symbols, found = df.select(syncmers.symbols(F.col("t")), syncmers.anchors(F.col("t"))).first()
    assert "".join(symbols) == text
    inner = [r[0] for r in spark.createDataFrame(list(zip(symbols, symbols[1:], strict=False)), "a string, b string").select(F.xxhash64("a", "b")).collect()]
    want = [i for i in range(len(inner) - 2) if min(inner[i : i + 3]) in (inner[i], inner[i + 2])]
    assert [a["at"] for a in found] == want


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(9)
    gaps = []
    for _ in range(30):
        u = rng.integers(0, 2**63, 200).astype(np.uint64)
        wa = rng.integers(0, 6, 200)
        wb = np.where(rng.random(200) < 0.6, wa, rng.integers(0, 30, 200))
        a, b = np.repeat(u, wa), np.repeat(u, wb)
        s = bagminhash.signatures([a, b], 512)
        want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        assert bagminhash.similarity(a, b) == pytest.approx(want)
        gaps.append((s[0] == s[1]).mean() - want)
    assert abs(np.mean(gaps)) < 0.015


def test_near_duplicate_classes_against_all_pairs(spark, odd, empty):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("aeioubcdt") for _ in range(rng.randint(3, 7)))
    texts = []
    for _ in range(12):
        text = [word() for _ in range(120)]
        texts.append(" ".join(text))
        for _ in range(rng.randint(0, 4)):
            copy = list(text)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(120)] = word()
            texts.append(" ".join(copy))
    texts += texts[:3]
    got = {r.doc_id: r.class_id for r in bagminhash.classes(documents(spark, texts)).collect()}
    bags = [bagminhash.shingles(bagminhash.word_hashes(bagminhash.words_of(t))) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if bagminhash.similarity(bags[i], bags[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert got == {i: min(j for j in range(len(texts)) if root[j] == root[i]) for i in range(len(texts))}
    rows = bagminhash.classes(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r.class_id for r in rows}
    assert by[3] == by[4] == 3 and by[2] == 2 and by[6] == 6
    kept = bagminhash.one_of_each(odd)
    assert kept.columns == odd.columns and kept.filter("text = 'word'").count() == 1
    assert bagminhash.classes(empty).count() == 0


def _template_family(rng, n_words, singles, pairs, own, shared):
    """Texts on one template, ``own`` words of each changed; pairs also share ``shared`` changes."""
    fresh = iter(range(10**6))
    base = [f"w{next(fresh)}" for _ in range(n_words)]

    def changed(words, n):
        out = list(words)
        for at in rng.sample(range(len(out)), n):
            out[at] = f"w{next(fresh)}"
        return out

    texts = [changed(base, own + shared) for _ in range(singles)]
    for _ in range(pairs):
        start = changed(base, shared)
        texts += [changed(start, own), changed(start, own)]
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


def _least_of_component(n, linked):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return {i: top(i) for i in range(n)}


def test_near_duplicates_of_a_template_family(spark, monkeypatch):
    texts = _template_family(random.Random(11), 400, 120, 60, 4, 3)
    bags = [bagminhash.shingles(bagminhash.word_hashes(bagminhash.words_of(t))) for t in texts]
    want = _least_of_component(len(texts), lambda i, j: bagminhash.similarity(bags[i], bags[j]) >= 0.8)
    assert 30 < len(texts) - len(set(want.values())) < 90
    docs = documents(spark, texts)
    assert {r.doc_id: r.class_id for r in bagminhash.classes(docs).collect()} == want
    monkeypatch.setattr(bagminhash, "BLOCK", 20)  # many cells a bucket
    assert {r.doc_id: r.class_id for r in bagminhash.classes(docs).collect()} == want


def test_overlaps_of_multisets():
    rng = np.random.default_rng(12)
    rows = [rng.integers(0, 60, n).astype(np.uint64) for n in (200, 1, 90, 40)]
    got = bagminhash.overlaps(rows)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            assert got[i, j] == sum((Counter(a.tolist()) & Counter(b.tolist())).values()) or i == j


def test_components(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)]
    root = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in root} == root
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_passages(spark, odd, empty):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeioubcdt") for _ in range(rng.randint(3, 7)))
    noise = lambda n: " ".join(word() for _ in range(n))
    passage, line = noise(60), [word() for _ in range(40)]
    other = list(line)
    other[20] = word()
    texts = [f"{noise(90)} {passage} {noise(80)}", f"{noise(33)} {passage} {noise(10)}", f"{noise(9)}\n{' '.join(line)}\n{noise(30)}", f"{' '.join(other)}\n{noise(44)}", noise(200), f"{noise(30)}\n{noise(40)}"]
    rows = paragraphs.repeats(documents(spark, texts + ODD)).collect()
    assert {r.doc_id for r in rows} == {0, 1, 2, 3}
    assert all(r.class_id == min(r.doc_id, {0: 0, 1: 0, 2: 2, 3: 2}[r.doc_id]) for r in rows)
    for r in rows:
        assert r.keep == (r.doc_id == r.class_id)
        part = texts[r.doc_id][r.start : r.end]
        assert part in passage if r.kind == "passage" and r.doc_id < 2 else len(part.split()) == r.n_words
    assert paragraphs.repeats(odd).count() == 0
    assert paragraphs.repeats(empty).count() == 0


def test_passages_of_pieces_with_different_owners(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("aeioubcdt") for _ in range(rng.randint(5, 9)))
    shared = [word() for _ in range(80)]
    h, start, end, _ = paragraphs.cut(" ".join(shared))
    cuts = [c for c in paragraphs.pieces(h) if paragraphs.REACH <= c < len(h) - paragraphs.REACH]  # whatever stands around
    inner = [shared[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    assert len(inner) > 3
    # Each second piece, with neighbours that keep its cuts, is in an earlier document of its own.
    earlier = []
    for a, b in list(zip(cuts[:-1], cuts[1:], strict=True))[1::2]:
        earlier.append(" ".join([word() for _ in range(30)] + shared[max(a - 5, 0) : b + 6] + [word() for _ in range(30)]))
    frame = lambda: " ".join([word() for _ in range(10)] + shared + [word() for _ in range(10)])
    late = [frame(), frame()]
    texts = earlier + late
    rows = [r for r in paragraphs.repeats(documents(spark, texts)).collect() if r.kind == "passage"]
    for doc in (len(earlier), len(earlier) + 1):
        own = [(r.start, r.end) for r in rows if r.doc_id == doc]
        for piece in inner:
            at = texts[doc].index(" ".join(piece))
            assert any(a <= at and at + len(" ".join(piece)) <= b for a, b in own)
        assert len({r.class_id for r in rows if r.doc_id == doc}) > 1


def test_paragraph_jaccard():
    a, b = np.arange(50, dtype=np.uint32), np.concatenate((np.arange(48), [99, 98])).astype(np.uint32)
    x, y = ({tuple(v[i : i + 5]) for i in range(len(v) - 4)} for v in (a, b))
    assert paragraphs.jaccard(a, b) == pytest.approx(len(x & y) / len(x | y))


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("aeioubcdt") for _ in range(rng.randint(3, 7)))
    texts = [" ".join(word() for _ in range(60)) + (" vileword" if i % 5 == 0 else "") for i in range(200)]
    texts[11] = texts[12]  # a copy
    item = " ".join(word() for _ in range(30))
    texts[21] += " " + item
    texts[31] += " password=abcdefgh"
    texts[41] = None
    docs = documents(spark, texts).withColumn("extra", F.lit("x"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
        assert name == "pieces" or set(docs.columns) == set(now.columns)
    every = set(range(200))
    assert kept[0] == every - {i for i in range(200) if i % 5 == 0}
    assert kept[1] == kept[0] - {12}
    assert kept[2] == kept[1] - {21}
    assert kept[3] == kept[4] == kept[2]
    red = spark.read.parquet(str(tmp_path / "secrets")).filter("doc_id = 31").first()
    assert red.text.endswith("[secret]") and red.n_chars == len(red.text)
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(r.doc_id for r in run.collect()) == Counter(kept[4])


def test_operators_survive_odd_and_empty_tables(spark, odd, empty):
    n = odd.count()
    assert pii.digest(pii.sanitise(odd)).count() == n and pii.sanitise(empty).count() == 0
    assert secrets.digest(secrets.scan(odd)[0]).count() == n and secrets.scan(empty)[0].count() == 0
    assert secrets.redacted(odd).columns == odd.columns
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.leaks(odd, bench).count() == 0 and decontam.without_leaks(odd, bench).count() == n
