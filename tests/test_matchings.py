"""Distances between diagrams against all assignments."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from sparkstrata.operators import bars as B


def _diagram(rng, n):
    birth = rng.integers(0, 6, n).astype(float)
    return np.stack([birth, birth + rng.integers(1, 7, n)], 1)


def _all_matchings(a, b, q):
    """Costs of every assignment of both diagrams' points and diagonals."""
    c = B._costs(a, b, q)
    n, m = len(a), len(b)
    c[n:, m:] = 0
    for perm in itertools.permutations(range(n + m)):
        yield [c[i, j] for i, j in enumerate(perm)]


@pytest.mark.parametrize("seed", range(12))
def test_small_diagrams_against_all_matchings(seed):
    rng = np.random.default_rng(seed)
    a, b = _diagram(rng, rng.integers(0, 4)), _diagram(rng, rng.integers(0, 4))
    rows = list(_all_matchings(a, b, np.inf))
    assert B.bottleneck(a, b) == pytest.approx(min(max(r, default=0) for r in rows))
    for p, q in ((1.0, 1.0), (2.0, np.inf), (2.0, 2.0)):
        rows = list(_all_matchings(a, b, q))
        assert B.wasserstein(a, b, p, q) == pytest.approx(min(sum(x**p for x in r) for r in rows) ** (1 / p))


@pytest.mark.parametrize("seed", range(6))
def test_repeated_points_against_the_assignment_of_each(seed):
    rng = np.random.default_rng(100 + seed)
    a, b = _diagram(rng, 40), _diagram(rng, 55)
    c = B._costs(a, b, 1.0)
    c[40:, 55:] = 0
    assert B.wasserstein(a, b, 1.0, 1.0) == pytest.approx(c[np.arange(95), B.assignment(c)].sum())
    inf = B._costs(a, b, np.inf)
    inf[40:, 55:] = 0
    d = B.bottleneck(a, b)
    assert B.covers(inf <= d) and not B.covers(inf <= d - 0.25)


def test_covers():
    assert B.covers(np.zeros((0, 3), bool)) and not B.covers(np.zeros((1, 3), bool))
    assert B.covers(np.array([[1, 1, 0], [1, 0, 0], [0, 1, 1]], bool))
    assert not B.covers(np.array([[1, 0], [1, 0]], bool))
