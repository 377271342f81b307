"""Modules, filtration families, slices and generators."""

from __future__ import annotations

import pytest

from sparkstrata.operators import complexes, filtrations, graphs, modules, slices
from sparkstrata.sources import synthetic

CHAIN = [0, 1, 2, 3]
COVERS = [(0, 1), (1, 2), (2, 3)]
FIELDS = [None, 2, 3, 5, "real"]


def bar(b, d, field=None):
    return modules.interval(CHAIN, COVERS, set(range(b, d)), field)


@pytest.mark.parametrize("field", FIELDS)
def test_intervals_on_a_chain(field):
    for b1 in range(4):
        for d1 in range(b1 + 1, 5):
            m = bar(b1, d1, field)
            assert m.generators() == {v: int(v == b1) for v in CHAIN}
            assert m.cogenerators() == {v: int(v == d1 - 1) for v in CHAIN}
            assert m.rank_map(b1, d1 - 1) == 1 and m.commutes()
            for b2 in range(4):
                for d2 in range(b2 + 1, 5):
                    # A map exists iff it starts at or after the other's birth, and before its death, and ends after it.
                    assert modules.hom_dimension(m, bar(b2, d2, field)) == int(b2 <= b1 < d2 <= d1)
                    assert modules.ext1_dimension_chain(m, bar(b2, d2, field), CHAIN) == int(b1 < b2 <= d1 < d2)


def test_sums_kernels_and_restriction(spark):
    m, n = bar(0, 3), bar(0, 2)
    both = modules.direct_sum(m, n)
    assert both.dims == {0: 2, 1: 2, 2: 1, 3: 0}
    assert modules.hom_dimension(both, n) == modules.hom_dimension(m, n) + modules.hom_dimension(n, n)
    f = {0: [[1]], 1: [[1]], 2: [], 3: []}
    got = modules.morphism_dims(m, n, f)
    assert got.kernel.tolist() == [0, 0, 1, 0] and got.image.tolist() == [1, 1, 0, 0] and got.cokernel.tolist() == [0, 0, 0, 0]
    with pytest.raises(ValueError):
        modules.morphism_dims(n, m, {0: [[1]], 1: [[1]], 2: [[]], 3: []})
    assert modules.restriction(both, {0: 1, 1: 3}, [(0, 1)]).dims == {0: 2, 1: 0}
    table = modules.table_of({1: m, 2: both}, spark)
    assert sorted(tuple(r) for r in modules.betti(table).collect()) == [(1, 0, 1), (2, 0, 2)]
    assert sorted(tuple(r) for r in modules.bass(table).collect()) == [(1, 2, 1), (2, 1, 1), (2, 2, 1)]


def test_families(spark):
    pts = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 2), (1, 1.0, 0.0, 0.0, 5), (2, 0.0, 1.0, 0.0, 1), (3, 9.0, 9.0, 9.0, 7)], "pid long, x double, y double, z double, label int")
    cells = {tuple(r.verts): (r.g1, r.g2) for r in filtrations.build("function_rips", pts, radius=1.5, value="label", max_dim=2).collect()}
    assert cells[0, 1] == (1.0, 5.0) and cells[0, 1, 2] == (pytest.approx(2**0.5), 5.0) and len(cells) == 8
    assert {r.g2 for r in filtrations.build("degree_rips", pts, radius=1.5).filter("dim = 1").collect()} == {2.0}
    assert {tuple(r.verts): r.g2 for r in filtrations.build("core", pts, radius=1.5).collect()}[3,] == 0.0
    assert {tuple(r.verts): (r.g1, r.g2) for r in filtrations.build("rhomboid", pts, radius=1.1, value="label").collect()}[0, 2] == (1.0, 2.0)
    assert filtrations.build("rips", pts, radius=1.1).count() == 6
    with pytest.raises(ValueError):
        filtrations.build("rips", pts)
    with pytest.raises(ValueError):
        filtrations.build("nothing", pts)
    assert "rips_codensity" in filtrations.available() and filtrations.signature("rips")["required"] == ("radius",)


def test_slices(spark):
    assert slices.directions(2) == [(2, 1), (1, 1), (1, 2)]
    line = slices.family(spark, [(1, 1)], [(0.0, 0.0)])
    chain = slices.chains(line, [0.0, 1.0, 2.0], [0.0, 1.5], 0.0, 6.0, 13).orderBy("pos").collect()
    assert [(r.i, r.j) for r in chain] == [(1, 1), (2, 1), (2, 2), (3, 2)]
    assert line.first().weight == 0.5


def test_generators(spark):
    assert synthetic.planar_grid_graph(spark, 3, 4).count() == 17
    v = spark.range(12).withColumnRenamed("id", "pid")
    assert graphs.components(v, synthetic.planar_grid_graph(spark, 3, 4)).select("root").distinct().count() == 1
    assert synthetic.noisy_annulus(spark, 50, noise=0.0).filter("abs(x*x + y*y - 1) > 1e-9").count() == 0
    assert synthetic.three_annuli(spark, 10).select("pid").distinct().count() == 30
    assert synthetic.gaussian_clusters(spark, 20, [(0, 0), (5, 5)]).groupBy("label").count().count() == 2
    board = synthetic.checkerboard(spark, 4)
    assert complexes.cell_counts(complexes.cubical_cells(board)).orderBy("dim").collect()[2].n_cells == 9
