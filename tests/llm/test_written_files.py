"""Small intermediate tables go to few files, however many shuffle partitions there are."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from sparkstrata.llm import bagminhash, common, components


@pytest.fixture
def many_partitions(spark, tmp_path, monkeypatch):
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    yield tmp_path
    for k, v in before.items():
        spark.conf.set(k, v)


def _files(folder: Path, name: str) -> list[int]:
    return [len(list(p.glob("part-*"))) for p in folder.glob(f"{name}-*")]


def _least(edges: list[tuple[int, int]]) -> dict[int, int]:
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return {x: r for x, r in root.items() if x != r}


def test_rounds_of_a_small_graph_write_few_files(spark, many_partitions):
    draw = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60) if i % 7] + [(draw.randrange(100, 400), draw.randrange(100, 400)) for _ in range(200)] + [(500, 500 + i) for i in range(1, 90)]
    edges = [(a, b) for a, b in edges if a != b]
    got = components.components(spark.createDataFrame(edges, "a long, b long"), rows=len(edges))
    assert {r["node"]: r["root"] for r in got.collect()} == _least(edges)
    assert _files(many_partitions, "least") and max(_files(many_partitions, "least")) <= common.LEAST_FILES
    assert _files(many_partitions, "edges") and max(_files(many_partitions, "edges")) <= common.LEAST_FILES


def test_heads_of_few_buckets_write_few_files(spark, many_partitions):
    rows = [(n, k) for k in range(300) for n in (k, k + 1, 1000 + k % 5)]
    _, heads = bagminhash.buckets(spark.createDataFrame(rows, "node long, key long"), len(rows))
    assert {r["key"] for r in heads.collect()} == set(range(300))
    for name in ("full", "bucket-heads"):
        assert max(_files(many_partitions, name)) <= common.LEAST_FILES


def test_expected_rows_are_no_cap(spark, many_partitions):
    table = common.written(spark.range(0, 1000, 1, 64).distinct(), "wide", 1)
    assert table.count() == 1000
