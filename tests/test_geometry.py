"""Delaunay complexes, centralities and distance transforms against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from sparkstrata.operators import centrality, delaunay, images


def test_triangulation_has_empty_circles():
    rng = np.random.default_rng(1)
    for n in (3, 8, 25):
        xy = rng.random((n, 2))
        tri = delaunay.triangulate(xy)
        for t in tri:
            a, b, c = (xy[k] for k in t)
            if delaunay._orient(a, b, c) < 0:
                b, c = c, b
            assert all(delaunay._in_circle(a, b, c, xy[k]) <= 1e-9 for k in range(n) if k not in t)
        edges = {e for t in tri for e in ((t[0], t[1]), (t[0], t[2]), (t[1], t[2]))}
        assert n - len(edges) + len(tri) == 1  # a disc


def test_alpha_grades(spark):
    pts = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 2.0, 0.0), (0, 2, 1.0, 0.2), (1, 0, 0.0, 0.0), (1, 1, 4.0, 0.0), (2, 0, 0.0, 0.0), (2, 1, 1.0, 1.0), (2, 2, 2.0, 2.0)], "cloud long, pid long, x double, y double")
    rows = {(r.cloud, tuple(r.verts)): r for r in delaunay.cells(pts).collect()}
    top = rows[0, (0, 1, 2)]
    assert rows[0, (0, 1)].alpha == pytest.approx(top.alpha)  # its circle holds the third point
    assert rows[0, (0, 2)].alpha == pytest.approx(0.26)
    assert rows[1, (0, 1)].radius == 2.0 and rows[1, (0, 1)].alpha == 4.0
    assert {k[1] for k in rows if k[0] == 2} == {(0,), (1,), (2,), (0, 1), (1, 2)}
    values = pts.select("cloud", "pid", (pts.pid * 10.0).alias("value"))
    got = {(r.cloud, tuple(r.verts)): (r.g1, r.g2) for r in delaunay.function_cells(delaunay.cells(pts), values).collect()}
    assert got[0, (0, 1)] == (1.0, 10.0) and got[0, (0, 1, 2)][1] == 20.0


def test_centralities(spark):
    v = spark.createDataFrame([(i,) for i in range(6)], "pid long")
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (1, 3)], "u long, v long")
    close = {r.pid: r.value for r in centrality.closeness(v, e).collect()}
    assert close[1] == 1.0 and close[0] == pytest.approx(3 / 5) and close[5] == 0
    between = {r.pid: r.value for r in centrality.betweenness(v, e).collect()}
    assert between == {0: 0.0, 1: 2.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0}


def test_distance_transform(spark):
    rng = np.random.default_rng(2)
    mask = rng.random((7, 9)) < 0.15
    mask[3, 4] = True
    df = spark.createDataFrame([(i, j, bool(mask[i, j])) for i in range(7) for j in range(9)], "i long, j long, mask boolean")
    at = np.argwhere(mask)
    for r in images.distance_transform(df, 7).collect():
        assert r.value == pytest.approx(np.sqrt(((at - [r.i, r.j]) ** 2).sum(1).min()))
