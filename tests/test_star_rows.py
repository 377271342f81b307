"""Complexes of dense clouds: no step has more rows than points dealt out or rows asked for, so none for a pair that is only tried."""

from __future__ import annotations

import random
from pathlib import Path

import duckdb
import pytest

from sparkstrata.plans import registry

DENSE, POINTS = "/root/testdata/sf0.1", 2000


def most_rows(spark):
    """The most rows that a step of the last execution gave."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last().executionId()
    found, nodes, most = store.executionMetrics(last), store.planGraph(last).allNodes(), 0
    for i in range(nodes.size()):
        metrics = nodes.apply(i).metrics()
        for k in range(metrics.size()):
            m = metrics.apply(k)
            if m.name() == "number of output rows" and found.contains(m.accumulatorId()):
                most = max(most, int(found.apply(m.accumulatorId()).replace(",", "")))
    return most


def rows_and_most(spark, name, sf=DENSE):
    df = registry.queries()[name](spark, sf)
    rows, most = df.collect(), most_rows(spark)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    cur = con.execute(registry.oracle_sql()[name])
    order = [d[0] for d in cur.description]
    fine = lambda r: tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(fine(r[c] for c in order) for r in rows) == sorted(fine(r) for r in cur.fetchall())
    return len(rows), most


def test_dominated_edges_are_no_rows(spark, tmp_path):
    drawn = random.Random(7)
    rows = [(i, [drawn.uniform(0, 0.03) for _ in range(3)], 0) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(f"{tmp_path}/t")
    next(Path(tmp_path, "t").glob("*.parquet")).rename(f"{tmp_path}/embeddings.parquet")
    rows, most = rows_and_most(spark, "dominated_edges", str(tmp_path))
    assert 0 < rows < 400 * 27 and 0 < most <= 400 * 27  # of 79,800 edges


@pytest.mark.parametrize("name", ["triangles", "boundary_faces", "cliques"])
def test_only_points_and_results_are_rows(spark, name):
    rows, most = rows_and_most(spark, name)
    assert 0 < most <= max(27 * POINTS, rows)
