"""Numbers of edges and triangles without a row for each: against all triples, SQL and closed forms."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sparkstrata.functions import near
from sparkstrata.operators import complexes
from sparkstrata.plans import registry

RADIUS = 0.06


def all_triples(places, weight, own):
    """Edges and triangles with the first point among the first ``own`` places, each place as often as its weight."""
    at = np.repeat(np.arange(len(places)), weight)
    gap = places[at][:, None] - places[at][None]
    adjacent = (np.sqrt(gap[..., 0] ** 2 + gap[..., 1] ** 2 + gap[..., 2] ** 2) <= RADIUS) & np.triu(np.ones((len(at), len(at)), bool), 1)
    first, adjacent = at < own, adjacent.astype(np.int64)
    return int(adjacent[first].sum()), int((adjacent[first] @ adjacent * adjacent[first]).sum())


@pytest.mark.parametrize("table, bits", [(1 << 16, 1 << 26), (100, 256), (7, 64), (5000, 1024)])
def test_cliques_of_a_cell_are_all_triples(monkeypatch, table, bits):
    monkeypatch.setattr(near, "TABLE", table)
    monkeypatch.setattr(near, "BITS", bits)
    rng = np.random.default_rng(7)
    for n, most in (1, 1), (2, 3), (64, 1), (65, 5), (200, 1), (190, 9):
        places, weight, own = rng.random((n, 3)) * 0.15, rng.integers(1, most + 1, n), int(rng.integers(1, n + 1))
        assert near.cliques_of(list(places.T.copy()), weight, own, near.longest_square(RADIUS)) == all_triples(places, weight, own)


def test_squares_are_judged_as_their_roots():
    for radius in 0.06, 0.1, 1 / 3, 7e5:
        square = near.longest_square(radius)
        assert math.sqrt(square) <= radius < math.sqrt(math.nextafter(square, math.inf))


def test_groups_go_on_in_the_next_batch():
    keys, cuts = [0, 0, 0, 1, 1, 2, 2, 2, 2, 3], [0, 2, 2, 3, 4, 7, 9, 10]
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(keys[i:j], pa.int64()), "v": pa.array(range(i, j), pa.int64())}) for i, j in zip(cuts, cuts[1:], strict=False)]
    runs = [([0] * 3, [0, 1, 2]), ([1] * 2, [3, 4]), ([2] * 4, [5, 6, 7, 8]), ([3], [9])]
    assert [(k.tolist(), v.tolist()) for k, v in near.groups(iter(batches), 1)] == runs
    whole = [pa.RecordBatch.from_pydict({"k": pa.array(keys, pa.int64()), "v": pa.array(range(10), pa.int64())})]
    assert [(k.tolist(), v.tolist()) for k, v in near.groups(iter(whole), 1)] == runs
    assert [(k.tolist(), v.tolist()) for k, v in near.groups(iter(whole), 1, lambda cols, starts, ends: ends - starts > 2)] == [runs[0], runs[2], runs[3]]


def written(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(f"{tmp_path}/t")
    next(Path(tmp_path, "t").glob("*.parquet")).rename(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet')")
    got = registry.queries()["cell_counts"](spark, str(tmp_path))
    return got.dtypes, sorted(map(tuple, got.collect())), sorted(con.execute(registry.oracle_sql()["cell_counts"]).fetchall())


@pytest.mark.parametrize("n", [0, 1, 3])
def test_no_edges_are_counted_as_zero(spark, tmp_path, n):
    kinds, got, want = written(spark, tmp_path, [(i, [float(i), 0.0, 0.0], 0) for i in range(n)])
    assert got == want == [(0, n), (1, 0)] and kinds == [("dim", "int"), ("n_cells", "bigint")]


def test_copies_of_a_point_cost_no_row_for_a_pair(spark):
    n, m = 40_000, 300  # two places near one another, and a third that is near to neither
    rows = spark.range(n + 2 * m).selectExpr("id AS pid", f"CASE WHEN id < {n} THEN 0.0D WHEN id < {n + m} THEN 0.05D ELSE 0.5D END AS x", "0.0D AS y", "IF(id % 2 = 0, 0.0D, -0.0D) AS z")
    got = sorted(map(tuple, complexes.rips_cell_counts(rows, RADIUS).collect()))
    assert got == [(0, n + 2 * m), (1, math.comb(n + m, 2) + math.comb(m, 2)), (2, math.comb(n + m, 3) + math.comb(m, 3))]


@pytest.mark.parametrize("share", [0.02, 0.5, 1.0])
def test_repeated_ids_count_as_edges_joined_by_ids(spark, tmp_path, share):
    rng = np.random.default_rng(3)
    ids = [*range(400), *(int(i) for i in range(400) if rng.random() < share), *(7, 7, 9)]
    places = rng.random((len(ids), 3)) * 0.2
    places[5] = places[6] = places[len(ids) - 1]
    kinds, got, want = written(spark, tmp_path, [(i, [float(c) for c in p], 0) for i, p in zip(ids, places, strict=True)])
    assert got == want and got[2][1] > 1000


def test_far_points_meet_as_near_ones_do(spark, tmp_path):
    """Cells of points far out, where a quotient by 0.06 would be rounded over a border."""
    step = math.ulp(3e11)
    at = [3e11 + i * step for i in range(400)]
    kinds, got, want = written(spark, tmp_path, [(i, [x, 0.0, -x], 0) for i, x in enumerate(at)])
    assert got == want and got[1][1] > 0
