"""Neighbour graphs and vertex functions of point clouds.

A point table has ``pid`` and one double column for each axis. Pairs within a radius are found by equi-joins on cells
of that side length: a point meets the points of its own and the neighbouring cells only, in the first two axes. Work
thus follows the number of near pairs. Nearest neighbours use the same join and widen the radius for the points that
have too few, so no step looks at all pairs and the result is exact. Stars hold each point's near points in one row, so
that what is asked of pairs and triples among them needs no exchange of a row for each pair or triple.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from ..functions import near
from ..functions.columns import distance
from ..functions.store import cut

AXES = ("x", "y", "z")


def near_pairs(points: DataFrame, radius: float, axes: tuple[str, ...] = AXES, left: DataFrame | None = None) -> DataFrame:
    """``a, b, d``: ordered pairs of different points at most ``radius`` apart; ``left`` restricts ``a``."""
    if radius <= 0:
        raise ValueError("radius must be positive")
    plane = axes[:2]
    cells = [F.floor(F.col(c) / F.lit(float(radius))).alias(f"c{i}") for i, c in enumerate(plane)]
    right = points.select(F.col("pid").alias("b"), *axes, *cells)
    steps = F.array(*(F.struct(*(F.lit(s).alias(f"s{i}") for i, s in enumerate(shift))) for shift in itertools.product((-1, 0, 1), repeat=len(plane))))
    own = (left or points).select(F.col("pid").alias("a"), *axes, *cells).withColumn("s", F.explode(steps))
    own = own.select("a", *axes, *((F.col(f"c{i}") + F.col(f"s.s{i}")).alias(f"c{i}") for i in range(len(plane))))
    met = own.alias("p").join(right.alias("q"), [F.col(f"p.c{i}") == F.col(f"q.c{i}") for i in range(len(plane))])
    return met.filter(F.col("a") != F.col("b")).select("a", "b", distance("p", "q", axes).alias("d")).filter(F.col("d") <= radius)


def repeated_ids(points: DataFrame) -> bool:
    return not points.filter("pid IS NOT NULL").groupBy("pid").count().filter("count > 1").isEmpty()


def stars(points: DataFrame, radius: float, axes: tuple[str, ...] = AXES, carry: tuple[str, ...] = (), both: bool = False) -> DataFrame:
    """``own, near``: each point (pid, axes, ``carry``) with its points within the radius (d, pid, axes, ``carry``).

    ``near`` holds the points of higher id, with ``both`` those of any other id, the nearest first. Points that would
    hold none are left out. Only points are dealt out: each goes to the cells around its own, and a point's star is
    gathered where its cell is. Tasks follow the number of points.
    """
    if radius <= 0:
        raise ValueError("radius must be positive")
    keys, side = [f"c{i}" for i in range(len(axes))], float(radius) * (1 + 1e-6)  # a little wider, so that no rounding parts two near points by two cells
    cells = [F.floor(F.greatest(F.least(F.col(c) / F.lit(side), F.lit(1e18)), F.lit(-1e18))).alias(k) for k, c in zip(keys, axes, strict=True)]
    tasks = max(8, points.count() // 128)
    around = points.select(F.struct("pid", *axes, *carry).alias("q"), *cells)
    for k in keys:
        around = around.withColumn(k, F.explode(F.array(*(F.col(k) + F.lit(s) for s in (-1, 0, 1)))))
    own = points.select(F.struct("pid", *axes, *carry).alias("own"), *cells).repartition(tasks, *keys)
    met = around.repartition(tasks, *keys).join(own.hint("shuffle_hash"), keys).filter(F.col("own.pid") != F.col("q.pid") if both else F.col("own.pid") < F.col("q.pid"))
    met = met.withColumn("d", distance("own", "q", axes)).filter(F.col("d") <= radius)
    found = met.groupBy(*keys, "own").agg(F.collect_list(F.struct("d", "q.*")).alias("near"))
    return found.select("own", F.sort_array("near").alias("near") if both else "near")


def cell_keys(radius: float, axes: tuple[str, ...]) -> list[Column]:
    """Cells a little wider than the radius; their side is a power of two, so that no rounding parts two near points by two cells."""
    side = 2.0 ** math.ceil(math.log2(radius * (1 + 1e-9)))
    return [F.floor(F.greatest(F.least(F.col(c) / F.lit(side), F.lit(1e18)), F.lit(-1e18))).alias(f"c{i}") for i, c in enumerate(axes)]


def shifted(points: DataFrame, shifts: list[tuple[int, ...]]) -> DataFrame:
    """Each point in its cell moved by each of the shifts; ``own``: whether it stayed."""
    to = F.array(*(F.struct(*(F.lit(s).alias(f"s{i}") for i, s in enumerate(shift)), F.lit(not any(shift)).alias("own")) for shift in shifts))
    keys = [f"c{i}" for i in range(len(shifts[0]))]
    rest = [c for c in points.columns if c not in keys]
    return points.withColumn("to", F.explode(to)).select(*((F.col(k) + F.col(f"to.s{i}")).alias(k) for i, k in enumerate(keys)), F.col("to.own").alias("own"), *rest)


def gathered(points: DataFrame, radius: float, axes: tuple[str, ...] = AXES, carry: tuple[str, ...] = ()) -> DataFrame:
    """``c0, ..., own, pid``, axes, ``carry``: the points of each cell, its own ones first, and of the cells around it.

    Cells lie together, one after the other. Only points are dealt out, and tasks follow their number. Points without an
    id or a finite place have no edge and are left out.
    """
    if radius <= 0:
        raise ValueError("radius must be positive")
    tasks = min(20_000, max(8, points.count() // 512))
    placed = points.filter("pid IS NOT NULL")
    for c in axes:
        placed = placed.filter(F.abs(F.col(c)) < F.lit(math.inf))
    keys = [f"c{i}" for i in range(len(axes))]
    dealt = shifted(placed.select(*cell_keys(radius, axes), "pid", *axes, *carry), list(itertools.product((-1, 0, 1), repeat=len(axes))))
    return dealt.repartition(tasks, *keys).sortWithinPartitions(*keys, F.desc("own"))


def in_stars(points: DataFrame, radius: float, axes: tuple[str, ...], kind: T.StructType, find: Callable[[list[np.ndarray], np.ndarray, pa.Array], Iterator[list[pa.Array]]], label: str = "pid") -> DataFrame:
    """Rows of ``kind`` that ``find`` (axes, places of a cell's own points, labels) makes of each cell's points in the order of ``pid``."""
    dims, as_arrow, named = len(axes), to_arrow_schema(kind), to_arrow_type(points.schema[label].dataType)

    def made(batches):
        held, size = [], 0
        worth = lambda cols, starts, ends: cols[dims][starts].astype(bool) & (ends - starts > 1)  # noqa: E731  a cell's own points come first
        for cols in near.groups(batches, dims, worth):
            own, pid, *at = cols[dims : 2 * dims + 2]
            order = np.argsort(pid, kind="stable")
            for found in find([c[order] for c in at], np.flatnonzero(own[order]), pa.array(cols[-1 if label != "pid" else dims + 1][order], named)):
                held.append(pa.RecordBatch.from_arrays(found, schema=as_arrow))
                size += held[-1].nbytes
                if size >= near.BATCH:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return gathered(points, radius, axes, () if label == "pid" else (label,)).mapInArrow(made, kind)


def radius_edges(points: DataFrame, radius: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """``u, v, d`` with u < v."""
    return near_pairs(points, radius, axes).filter("a < b").select(F.col("a").alias("u"), F.col("b").alias("v"), "d")


def nearest(points: DataFrame, k: int, start: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """``a, b, d, rank``: the ``k`` nearest other points of each, ties to the lower id. ``start``: a first radius.

    Points with fewer than ``k`` others within the radius are searched again at twice the radius.
    """
    total = points.count()
    if k >= total:
        raise ValueError("k must be smaller than the number of points")
    order = Window.partitionBy("a").orderBy("d", "b")
    radius, todo, found = start, points, None
    while True:
        near = near_pairs(points, radius, axes, todo).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        near = cut(near.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("a"))).filter(F.col("held") == k).drop("held"))
        found = near if found is None else found.unionByName(near)
        todo = cut(todo.join(near.select(F.col("a").alias("pid")).distinct(), "pid", "left_anti"))
        if todo.isEmpty():
            return found
        radius *= 2


def knn_edges(points: DataFrame, k: int, start: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """``u, v, d``: union of the directed nearest-neighbour edges."""
    near = nearest(points, k, start, axes)
    return near.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "d").distinct()


def knn_distance(points: DataFrame, k: int, start: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """``pid, value``: distance to the k-th neighbour."""
    return nearest(points, k, start, axes).filter(F.col("rank") == k).select(F.col("a").alias("pid"), F.col("d").alias("value"))


def dtm(points: DataFrame, mass: float, start: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """``pid, value``: distance to measure with k = floor(mass * n) + 1 neighbours, the point itself included."""
    n = points.count()
    k = int(mass * n) + 1
    if k > n:
        raise ValueError("mass is too large")
    if k == 1:
        return points.select("pid", F.lit(0.0).alias("value"))
    near = nearest(points, k - 1, start, axes)
    return near.groupBy(F.col("a").alias("pid")).agg(F.sqrt(F.sum(F.col("d") * F.col("d")) / F.lit(float(k))).alias("value"))


def landmark_edges(points: DataFrame, landmarks: DataFrame, radius: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Radius edges among the given landmark ids (``landmarks``: column pid)."""
    return radius_edges(points.join(landmarks, "pid", "left_semi"), radius, axes)


def farthest_points(points: DataFrame, m: int, axes: tuple[str, ...] = AXES) -> DataFrame:
    """``pid, step``: greedy farthest-point sample from the least id; ties to the lower id. One job a sample point."""
    first = points.agg(F.min("pid")).first()[0]
    chosen, state = [first], cut(points.select("pid", *axes, F.lit(float("inf")).alias("gap")))
    while len(chosen) < m:
        at = state.filter(F.col("pid") == chosen[-1]).select(*axes).first()
        total = sum(((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(axes, at, strict=True)), F.lit(0.0))
        state = cut(state.withColumn("gap", F.least("gap", F.sqrt(total))))
        best = state.agg(F.max(F.struct("gap", (-F.col("pid")).alias("neg")))).first()[0]
        if best["gap"] <= 0:
            break
        chosen.append(-best["neg"])
    return points.sparkSession.createDataFrame([(p, i) for i, p in enumerate(chosen)], "pid long, step int")


def without_dominated(edges: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Drops an edge (u, v, d) if some w has edges to both ends no longer than d (+ tolerance)."""
    both = edges.select("u", "v", "d").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "d"))
    left, right = both.select("u", F.col("v").alias("w"), F.col("d").alias("d1")), both.select("v", F.col("u").alias("w"), F.col("d").alias("d2"))
    seen = edges.join(left, "u").join(right, ["v", "w"]).filter(F.greatest("d1", "d2") <= F.col("d") + tolerance)
    return edges.join(seen.select("u", "v", "d").distinct(), ["u", "v", "d"], "left_anti")


def undominated_radius_edges(points: DataFrame, radius: float, axes: tuple[str, ...] = AXES, tolerance: float = 1e-12) -> DataFrame:
    """``without_dominated`` of the radius edges; a dominating point is looked for in the star of u, the nearest first."""
    if repeated_ids(points):
        return without_dominated(radius_edges(points, radius, axes), tolerance)
    pid = points.schema["pid"].dataType

    def find(at, own, labels):
        for p, others, d in near.undominated(at, own, radius, tolerance):
            yield [labels.take(pa.array(np.full(len(others), p))), labels.take(pa.array(others)), pa.array(d)]

    return in_stars(points, radius, axes, T.StructType().add("u", pid).add("v", pid).add("d", "double"), find)
