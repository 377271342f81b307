"""Complexes of dense clouds: the same rows as SQL and the joins, and no exchange of a row for each pair or triple."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkstrata.operators import complexes
from sparkstrata.operators import points as P
from sparkstrata.plans import registry, tables

DENSE, POINTS = "/root/testdata/sf0.1", 2000


def shuffled(spark):
    """Rows that all stages so far have written to exchanges."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def run(spark, name):
    before = shuffled(spark)
    df = registry.queries()[name](spark, DENSE)
    rows = df.collect()
    return df.columns, rows, shuffled(spark) - before


def sql(name, sf=DENSE):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    cur = con.execute(registry.oracle_sql()[name])
    return [d[0] for d in cur.description], cur.fetchall()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Points that coincide, lie on cell borders, at infinity, far out, without a place or an id; and ids that repeat."""
    at = [(1, 0.0, 0.0), (2, 0.06, 0.0), (3, -1e-18, 0.0), (4, 0.03, 0.03), (5, 0.03, 0.03), (6, 1e30, 0.0), (7, 1e30, 0.0), (8, float("inf"), 0.0), (9, float("nan"), 0.0), (10, None, 0.0), (11, 0.05, 0.01), (None, 0.01, 0.0)]
    frames = {}
    for name, found in {"distinct": at, "repeated": [r for r in at if r[0] not in (3, 6, 7, 8)] + [(4, 0.02, 0.01), (11, 0.04, 0.02), (5, 0.9, 0.9)]}.items():
        path = str(tmp_path_factory.mktemp(name))
        rows = [(i, None if x is None else [x, y, 0.0], (i or 0) % 3) for i, x, y in found]
        spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(f"{path}/t")
        next(Path(path, "t").glob("*.parquet")).rename(f"{path}/embeddings.parquet")
        frames[name] = path
    return frames


def same(spark, name, sf):
    df = registry.queries()[name](spark, sf)
    names, want = sql(name, sf)
    order = sorted(names)
    fine = lambda r, at: tuple(f"{at(r, c):.6g}" if isinstance(at(r, c), float) else str(at(r, c)) for c in order)
    assert sorted(df.columns) == order
    got = sorted(fine(r, lambda r, c: r[c]) for r in df.collect())
    assert got == sorted(fine(r, lambda r, c: r[names.index(c)]) for r in want)
    return got


def test_boundary_squared_deals_out_points_only(spark):
    _, rows, moved = run(spark, "boundary_squared")
    assert rows[0][0] == 0 and moved < 40 * POINTS


def test_boundary_squared_sees_every_triangle(spark):
    pts = tables.points(spark, DENSE)
    got = complexes.rips_boundary_squared(pts, tables.TRIANGLE_RADIUS)
    want = complexes.triangles(P.radius_edges(pts, tables.TRIANGLE_RADIUS))
    assert got.count() == want.count() == got.join(want, ["a", "b", "c"]).count()
    assert got.filter((F.col("sa") != 0) | (F.col("sb") != 0) | (F.col("sc") != 0)).isEmpty()


@pytest.mark.parametrize("kind", ["distinct", "repeated"])
def test_boundary_squared_of_odd_points(spark, odd, kind):
    same(spark, "boundary_squared", odd[kind])


def test_dominated_edges_deals_out_points_only(spark):
    columns, rows, moved = run(spark, "dominated_edges")
    pts = tables.points(spark, DENSE)
    want = P.without_dominated(P.radius_edges(pts, tables.TRIANGLE_RADIUS)).select("u", "v").collect()
    assert sorted((r.u, r.v) for r in rows) == sorted((r.u, r.v) for r in want) and moved < 40 * POINTS


@pytest.mark.parametrize("kind", ["distinct", "repeated"])
def test_dominated_edges_of_odd_points(spark, odd, kind):
    same(spark, "dominated_edges", odd[kind])


def test_triangles_deal_out_points_only(spark):
    columns, rows, moved = run(spark, "triangles")
    names, want = sql("triangles")
    assert sorted(tuple(r[c] for c in "abc") for r in rows) == sorted(r[:3] for r in want) and moved < 40 * POINTS


@pytest.mark.parametrize("kind", ["distinct", "repeated"])
def test_triangles_of_odd_points(spark, odd, kind):
    assert same(spark, "triangles", odd[kind])


def test_boundary_faces_deal_out_points_only(spark):
    columns, rows, moved = run(spark, "boundary_faces")
    names, want = sql("boundary_faces")
    assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(want) and moved < 80 * POINTS


@pytest.mark.parametrize("kind", ["distinct", "repeated"])
def test_boundary_faces_of_odd_points(spark, odd, kind):
    assert same(spark, "boundary_faces", odd[kind])


def test_cell_counts_deal_out_points_only(spark):
    columns, rows, moved = run(spark, "cell_counts")
    assert sorted(tuple(r) for r in rows) == sorted(sql("cell_counts")[1]) and moved < 80 * POINTS


@pytest.mark.parametrize("kind", ["distinct", "repeated"])
def test_cell_counts_of_odd_points(spark, odd, kind):
    assert same(spark, "cell_counts", odd[kind])


def test_cliques_deal_out_points_only(spark):
    columns, rows, moved = run(spark, "cliques")
    assert sorted(r.verts for r in rows) == sorted(r[0] for r in sql("cliques")[1]) and moved < 40 * POINTS


@pytest.mark.parametrize("kind", ["distinct", "repeated"])
def test_cliques_of_odd_points(spark, odd, kind):
    assert same(spark, "cliques", odd[kind])
