"""Operators against brute force and identities."""

from __future__ import annotations

import itertools
import random
from fractions import Fraction

import numpy as np
import pytest

from sparkstrata.functions import linalg
from sparkstrata.operators import bars, graphs, grids, points
from sparkstrata.sources import files
from sparkstrata.streaming import euler


def test_rank_agrees_over_fields():
    rng = random.Random(1)
    for _ in range(30):
        rows = [[rng.randint(-3, 3) for _ in range(4)] for _ in range(5)]
        q = linalg.rank(rows)
        assert q == linalg.rank(rows, "real") == max(linalg.rank(rows, p) for p in (10007, 10009))
        null = linalg.nullspace(rows, 4)
        assert len(null) == 4 - q
        assert all(sum(Fraction(a) * b for a, b in zip(r, x, strict=True)) == 0 for r in rows for x in null)


def test_rank_over_f2_can_drop():
    assert linalg.rank([[1, 1], [1, -1]]) == 2
    assert linalg.rank([[1, 1], [1, -1]], 2) == 1
    assert linalg.rank([]) == 0
    with pytest.raises(ValueError):
        linalg.rank([[1]], 4)


def test_solve_and_colspace():
    assert linalg.solve([[2, 0], [0, 4], [0, 0]], [[2], [2], [0]]) == [[1], [Fraction(1, 2)]]
    assert linalg.colspace([[1, 2, 0], [2, 4, 1]]) == [0, 2]
    with pytest.raises(ValueError):
        linalg.solve([[1], [1]], [[1], [2]])





def test_distances_against_all_matchings():
    rng = np.random.default_rng(2)
    for _ in range(6):
        a = np.sort(rng.integers(0, 9, (3, 2)), 1).astype(float)
        b = np.sort(rng.integers(0, 9, (2, 2)), 1).astype(float)
        c = bars._costs(a, b, np.inf)
        every = list(itertools.permutations(range(5)))
        assert bars.bottleneck(a, b) == pytest.approx(min(max(c[i, p[i]] for i in range(5)) for p in every))
        assert bars.wasserstein(a, b, 2.0) == pytest.approx(min(sum(c[i, p[i]] ** 2 for i in range(5)) for p in every) ** 0.5)
    assert bars.bottleneck(a, a) == 0
    assert bars.bottleneck(np.empty((0, 2)), np.empty((0, 2))) == 0
    assert bars.wasserstein(np.empty((0, 2)), np.array([[0.0, 4.0]])) == pytest.approx(2.0)


def test_bottleneck_triangle_inequality():
    rng = np.random.default_rng(3)
    x, y, z = (np.sort(rng.random((5, 2)), 1) for _ in range(3))
    assert bars.bottleneck(x, z) <= bars.bottleneck(x, y) + bars.bottleneck(y, z) + 1e-12


def test_components_cores_and_forest(spark):
    edges = [(0, 1), (1, 2), (0, 2), (2, 3), (5, 6)]
    v = spark.createDataFrame([(i,) for i in range(8)], "pid long")
    e = spark.createDataFrame(edges, "u long, v long")
    assert {r.pid: r.root for r in graphs.components(v, e).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7}
    assert {r.pid: r.value for r in graphs.core_numbers(v, e).collect()} == {0: 2, 1: 2, 2: 2, 3: 1, 4: 0, 5: 1, 6: 1, 7: 0}
    d = spark.createDataFrame([(u, w, float(u + 3 * w)) for u, w in edges], "u long, v long, d double")
    assert sorted(r.d for r in graphs.spanning_forest(d).collect()) == [3.0, 6.0, 11.0, 23.0]


def test_geodesic_and_pagerank(spark):
    v = spark.createDataFrame([(i,) for i in range(5)], "pid long")
    e = spark.createDataFrame([(0, 1, 2.0), (1, 2, 2.0), (0, 2, 9.0)], "u long, v long, w double")
    got = {r.pid: r.value for r in graphs.geodesic(v, e, spark.createDataFrame([(0,)], "pid long"), "w").collect()}
    assert got == {0: 0.0, 1: 2.0, 2: 4.0, 3: 5.0, 4: 5.0}
    rank = {r.pid: r.value for r in graphs.pagerank(v, e).collect()}
    assert sum(rank.values()) == pytest.approx(1.0)
    assert rank[3] == pytest.approx(rank[4])


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(4)
    xyz = rng.random((60, 3)).round(2)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "pid long, x double, y double, z double")
    got = {(r.a, r["rank"]): r.b for r in points.nearest(df, 3, 0.05).collect()}
    for i in range(60):
        d = sorted((float(np.sqrt(((xyz[i] - xyz[j]) ** 2).sum())), j) for j in range(60) if j != i)
        assert [got[i, k] for k in (1, 2, 3)] == [j for _, j in d[:3]] or [round(x, 9) for x, _ in d[:3]] == [round(float(np.sqrt(((xyz[i] - xyz[got[i, k]]) ** 2).sum())), 9) for k in (1, 2, 3)]


def test_farthest_points(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 10.0), (3, 6.0), (4, 6.0)], "pid long, x double")
    assert [r.pid for r in points.farthest_points(df, 4, ("x",)).orderBy("step").collect()] == [0, 2, 3, 1]


def test_surface_and_moebius_are_inverse(spark):
    m = spark.createDataFrame([(0, 0, 2), (1, 3, -1), (4, 3, 5)], "i long, j long, w long")
    back = {(r.i, r.j): r.w for r in grids.mobius(grids.surface(m)).collect()}
    assert back == {(0, 0): 2, (1, 3): -1, (4, 3): 5}


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "u long, v long, d double")
    assert graphs.spanning_forest(none).count() == 0
    assert grids.euler_measure(spark.createDataFrame([], "dim int, i long, j long")).count() == 0
    assert bars.summary(spark.createDataFrame([], "slice long, birth long, death long, mult long")).count() == 0


def test_text_readers(spark, tmp_path):
    lower = tmp_path / "lower.txt"
    lower.write_text("0\n1 0\n2 3 0\n")
    assert sorted(tuple(r) for r in files.distance_matrix(spark, str(lower), "lower").collect()) == [(0, 1, 1.0), (0, 2, 2.0), (1, 2, 3.0)]
    full = tmp_path / "full.txt"
    full.write_text("0 1 2\n1 0 3\n2 3 0\n")
    assert sorted(tuple(r) for r in files.distance_matrix(spark, str(full), radius=2.0).collect()) == [(0, 1, 1.0), (0, 2, 2.0)]
    upper = tmp_path / "upper.txt"
    upper.write_text("0 1 2\n0 3\n0\n")
    assert sorted(tuple(r) for r in files.distance_matrix(spark, str(upper), "upper").collect()) == [(0, 1, 1.0), (0, 2, 2.0), (1, 2, 3.0)]
    sparse = tmp_path / "sparse.txt"
    sparse.write_text("1 2 5\n2 1 4\n3 1 2\n")
    assert sorted(tuple(r) for r in files.sparse_distances(spark, str(sparse)).collect()) == [(0, 1, 4.0), (0, 2, 2.0)]
    simplices = tmp_path / "s.txt"
    simplices.write_text("# comment\n0 0 0.0\n1 0 1 0.5\n")
    assert [(r.verts, r.grade) for r in files.simplex_lines(spark, str(simplices)).collect()] == [([0], 0.0), ([0, 1], 0.5)]
    bi = tmp_path / "bi.txt"
    bi.write_text("--datatype bifiltration\n0 ; 0 0 1 2\n0 1 ; 1 1\n")
    assert sorted((r.verts, r.g1, r.g2) for r in files.bifiltration(spark, str(bi)).collect()) == [([0], 0.0, 0.0), ([0], 1.0, 2.0), ([0, 1], 1.0, 1.0)]


def test_binary_readers(spark, tmp_path):
    import struct

    low = tmp_path / "low.bin"
    low.write_bytes(struct.pack("<3d", 1.0, 2.0, 3.0))
    assert sorted(tuple(r) for r in files.binary_lower_distance(spark, str(low)).collect()) == [(0, 1, 1.0), (0, 2, 2.0), (1, 2, 3.0)]
    full = tmp_path / "full.bin"
    full.write_bytes(struct.pack("<3q9d", files.DIPHA_MAGIC, 7, 3, 0, 1, 2, 1, 0, 3, 2, 3, 0))
    assert sorted(tuple(r) for r in files.dipha_distances(spark, str(full)).collect()) == [(0, 1, 1.0), (0, 2, 2.0), (1, 2, 3.0)]


def test_own_json_is_strict(tmp_path):
    path = str(tmp_path / "x.json")
    files.save_json(path, "slices", {"a": [1]})
    assert files.load_json(path, "slices") == {"a": [1]}
    with pytest.raises(ValueError):
        files.load_json(path, "other")


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = euler.windowed_measure(euler.event_cells(stream, 5.0))
    q = out.writeStream.outputMode("complete").format("memory").queryName("euler_stream").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("euler_stream").collect())  # the session is in UTC
    assert got == sorted(tuple(r) for r in euler.windowed_measure(euler.event_cells(events, 5.0)).collect())
