"""What a worker keeps of chunks: small, bounded, and never another result."""

from __future__ import annotations

import random
import sys

from sparkstrata.llm import pieces

MODEL = pieces._model(pieces.MODEL_PATH)


def words(n: int) -> list[str]:
    rng = random.Random(5)
    return sorted({"".join(rng.choice(["the", "on", "er", "in", "ea", "tion"]) for _ in range(3)) + str(k) for k in range(n)})


def test_kept_chunks_are_small():
    own = pieces.Transducer(MODEL)
    own.encode(" ".join(words(3000)))
    kept = own.young | own.old
    assert len(kept) >= 3000
    assert sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in kept.items()) / len(kept) < 125  # 178 as marked text and tuples


def test_generations_are_bounded_and_change_no_result(monkeypatch):
    texts = [" ".join(words(400)[i : i + 90]) for i in range(0, 400, 30)] * 2
    want = [pieces.Transducer(MODEL).encode(t) for t in texts]
    monkeypatch.setattr(pieces, "CACHE_CHUNKS", 40)
    monkeypatch.setattr(pieces, "CACHE_PAIRS", 20)
    own = pieces.Transducer(MODEL)
    for t, ids in zip(texts, want, strict=True):
        assert own.encode(t) == ids
        assert len(own.young) <= 40 and len(own.old) <= 40 and len(own.pairs) <= 21


def test_spaces_and_marks_are_one_sign():
    own = pieces.Transducer(MODEL)
    for t in ["a▁b ▁ c", "▁", " ▁▁ x", "the▁thing, the thing", "\n▁a\n a", "é ▁日本 日▁本", "a" * 200 + "▁" * 70 + " " * 70]:
        assert own.encode(t) == own.encode(t.replace(" ", pieces.MARK)) == own.encode(t.replace(pieces.MARK, " "))
        assert own.decode(own.encode(t)) == t.replace(pieces.MARK, " ")
        assert list(memoryview(own.codes(t)).cast("i")) == own.encode(t)
