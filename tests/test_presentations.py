"""Places by ranges and signatures by blocks give what one task would."""

from __future__ import annotations

import random

from sparkstrata.functions.store import numbered
from sparkstrata.operators import presentations as S

GENS = "gen int, kind string, lo_x double, lo_y double, hi_x double, hi_y double"


def test_numbered_over_many_ranges(spark):
    values = random.Random(4).sample(range(-5000, 5000), 3000)
    rows = numbered(spark.createDataFrame([(v,) for v in values], "value long").repartition(7), "value").collect()
    assert sorted((r["pos"], r["value"]) for r in rows) == list(enumerate(sorted(values), 1))
    assert numbered(spark.createDataFrame([], "value long"), "value").isEmpty()


def test_signatures_by_blocks(spark, monkeypatch):
    r = random.Random(5)
    some = lambda: None if r.random() < 0.15 else float(r.randrange(20))
    ups = [(k, "up", some(), some(), None, None) for k in range(30)]
    downs = [(k, "down", None, None, some(), some()) for k in range(30)]
    points = sorted({(float(r.randrange(-2, 22)), float(r.randrange(-2, 22))) for _ in range(150)})
    p, g = spark.createDataFrame(points, "x double, y double"), spark.createDataFrame(ups + downs, GENS)
    fits = lambda low, high: all(a is None or b is None or a <= b for a, b in zip(low, high, strict=True))
    want = sorted((*q, [u[0] for u in ups if fits(u[2:4], q)], [d[0] for d in downs if fits(q, d[4:6])]) for q in points)
    for sent in (100_000, 10):
        monkeypatch.setattr(S, "SENT", sent)
        assert sorted(tuple(x) for x in S.signatures(p, g).collect()) == want
