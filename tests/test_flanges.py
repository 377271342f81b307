"""Flanges, Kan extensions and slice plans against plain versions."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest

from sparkstrata.functions import linalg
from sparkstrata.operators import filtrations as T
from sparkstrata.operators import flanges as L
from sparkstrata.operators import modules as M
from sparkstrata.operators import slices as S

GENS = "gen int, kind string, lo_x long, lo_y long, hi_x long, hi_y long"
PHI = "down int, up int, num long, den long"


def random_flange(seed):
    r = random.Random(seed)
    some = lambda low: None if r.random() < 0.2 else low + r.randrange(3)
    ups = [(k, "up", some(0), some(0), None, None) for k in range(5)]
    downs = [(k, "down", None, None, some(1), some(1)) for k in range(5)]
    phi = [(d, u, r.choice([-2, -1, 0, 1, 3]), r.choice([1, 2])) for d in range(5) for u in range(5) if r.random() < 0.7]
    return ups, downs, phi


def plain_rank(ups, downs, phi, g, h):
    """Rank of the image of the matrix at g seen at h: columns alive at g, rows alive at h."""
    cols = [u[0] for u in ups if all(b is None or b <= x for b, x in zip(u[2:4], g, strict=True))]
    rows = [d[0] for d in downs if all(b is None or x <= b for b, x in zip(d[4:6], h, strict=True))]
    at = {(d, u): Fraction(n, e) for d, u, n, e in phi}
    return linalg.rank([[at.get((d, u), 0) for u in cols] for d in rows]) if rows and cols else 0


@pytest.mark.parametrize("seed", [1, 2])
def test_module_on_box_and_minimize_keep_every_rank(spark, seed):
    ups, downs, phi = random_flange(seed)
    copies = [(u[0] + 10, *u[1:]) for u in ups], [(d[0] + 10, *d[1:]) for d in downs]
    doubled = phi + [(d, u + 10, -3 * n, 7 * e) for d, u, n, e in phi]
    doubled += [(d + 10, u, 5 * n, 2 * e) for d, u, n, e in doubled]
    gens, entries = spark.createDataFrame([*ups, *downs, *copies[0], *copies[1]], GENS), spark.createDataFrame(doubled, PHI)
    small, left = L.minimize(gens, entries)
    assert small.count() < gens.count()
    for table in ((gens, entries), (small, left)):
        got = {(r["x"], r["y"]): (r["dim"], r["rank_x"], r["rank_y"]) for r in L.module_on_box(spark, *table, (-1, -1), (3, 4)).collect()}
        assert len(got) == 30
        for x in range(-1, 4):
            for y in range(-1, 5):
                want = [plain_rank(ups, downs, phi, (x, y), h) for h in ((x, y), (x + 1, y), (x, y + 1))]
                assert got[x, y] == (want[0], want[1] if x < 3 else None, want[2] if y < 4 else None)


def test_degree_matrix_without_points(spark):
    ups, downs, phi = random_flange(3)
    gens, entries = spark.createDataFrame(ups + downs, GENS), spark.createDataFrame(phi, PHI)
    assert L.degree_matrix(gens, entries, spark.createDataFrame([], "x long, y long")).isEmpty()


def test_pushforwards_on_a_square():
    """The square 0 < 1, 2 < 3 mapped to a chain: colimits of its lower, limits of its upper sets."""
    covers = [(0, 1), (0, 2), (1, 3), (2, 3)]
    m = M.interval([0, 1, 2, 3], covers, {1, 2})
    order = {(a, b) for a in range(3) for b in range(3) if a <= b}
    along = {0: 0, 1: 1, 2: 1, 3: 2}
    assert M.pushforward_left_dims(m, along, order) == {0: 0, 1: 2, 2: 0}
    assert M.pushforward_right_dims(m, along, order) == {0: 0, 1: 2, 2: 0}
    full = M.interval([0, 1, 2, 3], covers, {0, 1, 2, 3})
    assert M.pushforward_left_dims(full, along, order) == {0: 1, 1: 1, 2: 1}


def test_directions_and_spread():
    assert S.spread([1, 2, 3], 5) == [1, 2, 3]
    assert S.spread(list(range(11)), 3) == [0, 5, 10]
    assert S.default_directions(1) == [(1.0,)]
    assert S.default_directions(2, 4, 2, scale="none") == [(2, 1), (1, 1), (1, 2)]
    assert all(abs(sum(v) - 1) < 1e-12 for v in S.default_directions(3, 10, 3))
    with pytest.raises(ValueError):
        S.spread([1], 0)


def test_filtrations_check_their_parameters(spark):
    v = spark.createDataFrame([(0,), (1,)], "pid long")
    e = spark.createDataFrame([(0, 1, 2.0)], "u long, v long, w double")
    assert sorted(map(tuple, T.build("graph_weight_threshold", v, edges=e).collect())) == [(0, [0], 0.0), (0, [1], 0.0), (1, [0, 1], 2.0)]
    with pytest.raises(ValueError):
        T.build("graph_weight_threshold", v, edges=e, lift="star")
    with pytest.raises(ValueError):
        T.build("graded", v)


def test_flange_and_feature_files_come_back(spark, tmp_path):
    from sparkstrata.sources import files

    ups, downs, phi = random_flange(6)
    files.save_flange_json(spark.createDataFrame(ups + downs, GENS), spark.createDataFrame(phi, PHI), str(tmp_path / "f.json"))
    gens, entries = files.load_flange_json(spark, str(tmp_path / "f.json"))
    assert sorted(map(str, gens.collect())) == sorted(map(str, spark.createDataFrame(ups + downs, GENS).collect()))
    assert sorted((r["down"], r["up"], Fraction(r["num"], r["den"])) for r in entries.collect()) == sorted((d, u, Fraction(n, e)) for d, u, n, e in phi if n)
    table = spark.createDataFrame([("a", 1.5, None), ("b", 2.0, 3.0)], "id string, f double, g double")
    files.save_features_npz(table, str(tmp_path / "x.npz"))
    back = files.load_features_npz(spark, str(tmp_path / "x.npz"))
    assert back.columns == table.columns and back.filter("id = 'b'").first()["g"] == 3.0
    with pytest.raises(ValueError):
        files.load(spark, str(tmp_path / "f.json"), "image")
