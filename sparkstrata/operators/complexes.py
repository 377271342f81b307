"""Simplicial and cubical complexes as cell tables, their grades, axes and boundaries."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import near
from ..functions.columns import distance, sign, simplex_value
from ..functions.store import cut, numbered
from . import points as P


def triangles(edges: DataFrame) -> DataFrame:
    """``a, b, c, d`` with a < b < c; d is the longest side. Edges have u < v."""
    ab = edges.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("d").alias("d1"))
    bc = edges.select(F.col("u").alias("b"), F.col("v").alias("c"), F.col("d").alias("d2"))
    ac = edges.select(F.col("u").alias("a"), F.col("v").alias("c"), F.col("d").alias("d3"))
    return ab.join(bc, "b").join(ac, ["a", "c"]).select("a", "b", "c", F.greatest("d1", "d2", "d3").alias("d"))


def cliques(edges: DataFrame, size: int) -> DataFrame:
    """``verts``: ascending vertex arrays of all cliques of ``size`` vertices; one join with edges for each vertex pair."""
    if size < 2:
        raise ValueError("size must be at least 2")
    now = edges.select(F.col("u").alias("v1"), F.col("v").alias("v2"))
    for k in range(3, size + 1):
        now = now.join(edges.select(F.col("u").alias(f"v{k - 1}"), F.col("v").alias(f"v{k}")), f"v{k - 1}")
        for j in range(1, k - 1):
            now = now.join(edges.select(F.col("u").alias(f"v{j}"), F.col("v").alias(f"v{k}")), [f"v{j}", f"v{k}"], "left_semi")
    return now.select(F.array(*(f"v{i}" for i in range(1, size + 1))).alias("verts"))


def function_cells(values: DataFrame, edges: DataFrame, agg: str = "max", with_triangles: bool = False) -> DataFrame:
    """``dim, verts, g1, g2``: diameter and aggregated vertex value. ``values``: pid, value."""
    val = lambda name, out: values.select(F.col("pid").alias(name), F.col("value").alias(out))
    cells = values.select(F.lit(0).alias("dim"), F.array("pid").alias("verts"), F.lit(0.0).alias("g1"), F.col("value").alias("g2"))
    one = edges.join(val("u", "f1"), "u").join(val("v", "f2"), "v")
    cells = cells.unionByName(one.select(F.lit(1).alias("dim"), F.array("u", "v").alias("verts"), F.col("d").alias("g1"), simplex_value(agg, F.col("f1"), F.col("f2")).alias("g2")))
    if with_triangles:
        two = triangles(edges).join(val("a", "f1"), "a").join(val("b", "f2"), "b").join(val("c", "f3"), "c")
        cells = cells.unionByName(two.select(F.lit(2).alias("dim"), F.array("a", "b", "c").alias("verts"), F.col("d").alias("g1"), simplex_value(agg, F.col("f1"), F.col("f2"), F.col("f3")).alias("g2")))
    return cells


def _nested(points: DataFrame, radius: float, size: int, axes: tuple[str, ...], carry: tuple[str, ...] = ()) -> DataFrame:
    """``v1, ..., d``: the points of each clique by ascending id, and its longest side, from stars and without an exchange."""
    now = P.stars(points, radius, axes, carry).select(F.col("own").alias("v1"), "near", F.explode("near").alias("v2")).withColumn("d", F.col("v2.d"))
    for k in range(3, size + 1):
        now = now.select("*", F.explode("near").alias(f"v{k}")).filter(F.col(f"v{k - 1}.pid") < F.col(f"v{k}.pid"))
        sides = [distance(f"v{j}", f"v{k}", axes) for j in range(2, k)]
        for side in sides:
            now = now.filter(side <= radius)
        now = now.withColumn("d", F.greatest("d", f"v{k}.d", *sides))
    return now.drop("near")


def _cofaces(points: DataFrame, radius: float, size: int, axes: tuple[str, ...], label: str = "pid", sides: bool = False, lone: bool = False) -> DataFrame:
    """``v1, ..., last``: the cliques of ``size`` points by ascending id, those with all but the last point alike in one row.

    Points are named by ``label``. ``last`` is an array, with ``sides`` there is an array ``d`` of the longest sides
    (of triangles). With ``lone`` edges that have no third point have a row as well.
    """
    square, named = near.longest_square(radius), points.schema[label].dataType
    kind = T.StructType()
    for i in range(1, size):
        kind = kind.add(f"v{i}", named)
    kind = kind.add("last", T.ArrayType(named))
    if sides:
        kind = kind.add("d", T.ArrayType(T.DoubleType()))
    arrays = [f.type for f in to_arrow_schema(kind)][size - 1 :]

    def find(at, own, labels):
        for heads, nexts, counts, lasts, squares in near.cofaces(at, own, square, size):
            if not lone:
                nexts, counts = nexts[counts > 0], counts[counts > 0]
                if not len(nexts):
                    continue
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            rows = [labels.take(pa.array(np.full(len(nexts), h))) for h in heads] + [labels.take(pa.array(nexts))]
            values = [labels.take(pa.array(lasts))] + ([pa.array(np.sqrt(squares))] if sides else [])
            yield rows + [pa.ListArray.from_arrays(ends, v, type=a) for v, a in zip(values, arrays, strict=True)]

    return P.in_stars(points, radius, axes, kind, find, label)


def rips_triangles(points: DataFrame, radius: float, axes: tuple[str, ...] = P.AXES) -> DataFrame:
    """``triangles`` of the radius edges, from the points; points that share an id go by their edges."""
    if P.repeated_ids(points):
        return triangles(P.radius_edges(points, radius, axes))
    found = _cofaces(points, radius, 3, axes, sides=True)
    return found.select(F.col("v1").alias("a"), F.col("v2").alias("b"), "d", F.posexplode("last").alias("i", "c")).select("a", "b", "c", F.get("d", F.col("i")).alias("d"))


def rips_cliques(points: DataFrame, radius: float, size: int, axes: tuple[str, ...] = P.AXES, label: str = "pid") -> DataFrame:
    """``cliques`` of the radius edges, from the points; points that share an id go by their edges. ``label`` names points, alike where the id is."""
    if size < 2:
        raise ValueError("size must be at least 2")
    verts = [f"v{i}" for i in range(1, size + 1)]
    if P.repeated_ids(points):
        found = cliques(P.radius_edges(points, radius, axes), size).select(*(F.get("verts", F.lit(i)).alias(v) for i, v in enumerate(verts)))
        if label != "pid":
            names = points.groupBy("pid").agg(F.first(label).alias("name"))
            for v in verts:
                found = found.join(names.withColumnRenamed("pid", v), v).drop(v).withColumnRenamed("name", v)
    elif size == 2:
        found = _nested(points, radius, 2, axes, () if label == "pid" else (label,)).select(*(F.col(f"{v}.{label}").alias(v) for v in verts))
    else:
        found = _cofaces(points, radius, size, axes, label).select(*verts[:-1], F.explode("last").alias(verts[-1]))
    return found.select(F.array(*verts).alias("verts"))


def rips_boundary(points: DataFrame, radius: float, axes: tuple[str, ...] = P.AXES) -> DataFrame:
    """``cell, face, coeff``: ``boundary`` of the radius edges and triangles, from the points; cells are ids joined by '-'."""
    if P.repeated_ids(points):
        edges = P.radius_edges(points, radius, axes)
        cells = edges.select(F.array("u", "v").alias("verts")).unionByName(triangles(edges).select(F.array("a", "b", "c").alias("verts")))
        name = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "-")
        return boundary(cells).select(name("verts").alias("cell"), name("face").alias("face"), "coeff")
    a, b, dash, none = F.col("v1"), F.col("v2"), F.lit("-"), F.lit(None).cast("string")
    edge, itself = F.concat(a, dash, b), F.array(F.lit(""))
    kind = lambda cell, face, whole, coeff, rest: F.struct(cell.alias("cell"), face.alias("face"), whole.alias("whole"), F.lit(coeff).alias("coeff"), rest.alias("rest"))
    tri = lambda face, whole, coeff: kind(F.concat(edge, dash), face, whole, coeff, F.col("last"))
    kinds = [kind(edge, b, none, 1, itself), kind(edge, a, none, -1, itself), tri(F.concat(b, dash), none, 1), tri(F.concat(a, dash), none, -1), tri(none, edge, 1)]
    found = _cofaces(points.withColumn("name", F.col("pid").cast("string")), radius, 3, axes, "name", lone=True)
    found = found.select(F.explode(F.array(*kinds)).alias("k")).select("k.*").select("cell", "face", "whole", "coeff", F.explode("rest").alias("last"))
    return found.select(F.concat("cell", "last").alias("cell"), F.coalesce("whole", F.concat("face", "last")).alias("face"), "coeff")


def rips_cells(points: DataFrame, radius: float, agg: str = "max", axes: tuple[str, ...] = P.AXES) -> DataFrame:
    """``function_cells`` of the radius edges with triangles, from the points and their column value.

    Where points share an id, triangles go by their edges, and the id's greatest value holds for them.
    """
    cells = points.select(F.lit(0).alias("dim"), F.array("pid").alias("verts"), F.lit(0.0).alias("g1"), F.col("value").alias("g2"))
    shared = P.repeated_ids(points)
    for size in (2,) if shared else (2, 3):
        ends = [f"v{i}" for i in range(1, size + 1)]
        one = _nested(points, radius, size, axes, ("value",))
        cells = cells.unionByName(one.select(F.lit(size - 1).alias("dim"), F.array(*(F.col(f"{v}.pid") for v in ends)).alias("verts"), F.col("d").alias("g1"), simplex_value(agg, *(F.col(f"{v}.value") for v in ends)).alias("g2")))
    if shared:
        values = points.groupBy("pid").agg(F.max("value").alias("value"))
        cells = cells.unionByName(function_cells(values, P.radius_edges(points, radius, axes), agg, with_triangles=True).filter("dim = 2"))
    return cells


def rips_boundary_squared(points: DataFrame, radius: float, axes: tuple[str, ...] = P.AXES) -> DataFrame:
    """``a, b, c, sa, sb, sc``: the row of boundary times boundary for each triangle, its entries at the three vertices.

    A face counts where it is an edge of the complex, and then with its own boundary.
    """
    verts = ("v1", "v2", "v3")
    at = dict.fromkeys(verts, F.lit(0))
    for i, out in enumerate(verts):
        u, v = (x for x in verts if x != out)
        held = (F.col(f"{u}.pid") < F.col(f"{v}.pid")) & (distance(u, v, axes) <= radius)
        at[v] += F.when(held, (-1) ** i).otherwise(0)
        at[u] += F.when(held, -((-1) ** i)).otherwise(0)
    return _nested(points, radius, 3, axes).select(*(F.col(f"{v}.pid").alias(c) for v, c in zip(verts, "abc", strict=True)), *(at[v].alias(f"s{c}") for v, c in zip(verts, "abc", strict=True)))


def boundary(cells: DataFrame) -> DataFrame:
    """``verts, face, coeff``: signed faces; coeff is (-1)^i for the face that leaves out vertex i."""
    faces = cells.filter(F.size("verts") > 1).select("verts", F.posexplode("verts").alias("i", "out"))
    return faces.select("verts", F.array_remove(F.col("verts"), F.col("out")).alias("face"), sign(F.col("i")).alias("coeff"))


def axes(cells: DataFrame, *grades: str) -> DataFrame:
    """``axis, pos, value``: sorted distinct grades of each axis; positions count from 1."""
    long = cells.select(F.explode(F.array(*(F.struct(F.lit(i + 1).alias("axis"), F.col(g).cast("double").alias("value")) for i, g in enumerate(grades)))).alias("s")).select("s.*").distinct()
    placed = cut(numbered(long, "axis", "value"))
    first = placed.groupBy("axis").agg(F.min("pos").alias("first"))
    return placed.join(F.broadcast(first), "axis").select("axis", (F.col("pos") - F.col("first") + 1).cast("int").alias("pos"), "value")  # a row an axis


def coarsen(axis: DataFrame, max_len: int) -> DataFrame:
    """Keeps at most ``max_len`` positions of each axis, evenly spread, both ends included (rounded, ties to even)."""
    n = F.max("pos").over(Window.partitionBy("axis"))
    if max_len < 2:
        raise ValueError("max_len must be at least 2")
    step = (F.col("n") - 1) / F.lit(float(max_len - 1))
    near = F.rint((F.col("pos") - 1) / step)  # the only sample index that can round to this position, or its neighbours
    hit = lambda j: (F.rint(1 + j * step) == F.col("pos")) & (j >= 0) & (j <= max_len - 1)
    kept = axis.withColumn("n", n).filter((F.col("n") <= max_len) | hit(near) | hit(near - 1) | hit(near + 1))
    return kept.drop("n")


def minimal_grades(grades: DataFrame) -> DataFrame:
    """Antichain of minimal grades of each cell (``cid, g1, g2``): a sweep over g1, no pair is formed."""
    best = F.min("g2").over(Window.partitionBy("cid").orderBy("g1", "g2").rowsBetween(Window.unboundedPreceding, -1))
    return grades.distinct().withColumn("best", best).filter(F.col("best").isNull() | (F.col("g2") < F.col("best"))).drop("best")


def one_critical(grades: DataFrame) -> DataFrame:
    """The lexicographically least grade of each cell."""
    return grades.groupBy("cid").agg(F.min(F.struct("g1", "g2")).alias("g")).select("cid", "g.g1", "g.g2")


def criticality(grades: DataFrame) -> DataFrame:
    """The largest number of distinct grades of a cell."""
    return grades.distinct().groupBy("cid").count().agg(F.max("count").alias("criticality"))


def cubical_cells(pixels: DataFrame) -> DataFrame:
    """``dim, i, j, di, dj, value``: vertices, edges and squares of an image (``i, j, value``), max over corners.

    An edge or square is named by its lowest corner and its extent; pixels that are missing bear no cell.
    """
    at = lambda di, dj, out: pixels.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("value").alias(out))
    v = pixels.select(F.lit(0).alias("dim"), "i", "j", F.lit(0).alias("di"), F.lit(0).alias("dj"), "value")
    e1 = at(0, 0, "a").join(at(1, 0, "b"), ["i", "j"]).select(F.lit(1).alias("dim"), "i", "j", F.lit(1).alias("di"), F.lit(0).alias("dj"), F.greatest("a", "b").alias("value"))
    e2 = at(0, 0, "a").join(at(0, 1, "b"), ["i", "j"]).select(F.lit(1).alias("dim"), "i", "j", F.lit(0).alias("di"), F.lit(1).alias("dj"), F.greatest("a", "b").alias("value"))
    sq = at(0, 0, "a").join(at(1, 0, "b"), ["i", "j"]).join(at(0, 1, "c"), ["i", "j"]).join(at(1, 1, "d"), ["i", "j"])
    sq = sq.select(F.lit(2).alias("dim"), "i", "j", F.lit(1).alias("di"), F.lit(1).alias("dj"), F.greatest("a", "b", "c", "d").alias("value"))
    return v.unionByName(e1).unionByName(e2).unionByName(sq)


def cell_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("dim").agg(F.count(F.lit(1)).alias("n_cells"))


def _counts_of_single_ids(points: DataFrame, radius: float, axes: tuple[str, ...], tasks: int) -> DataFrame:
    """``dim, n``: edges and triangles of points of different ids, summed by tasks.

    Points of one place are a row with their number. A cell meets the cells after it, in the order of their keys, and
    counts the edges and triangles whose first point is its own, so only places are dealt out, 14 times in three axes.
    """
    keys, square, dims = [f"c{i}" for i in range(len(axes))], near.longest_square(radius), len(axes)
    places = points.groupBy(*axes).agg(F.count(F.lit(1)).alias("weight")).select(*P.cell_keys(radius, axes), *axes, "weight")
    dealt = P.shifted(places, [s for s in itertools.product((0, -1, 1), repeat=dims) if tuple(-x for x in s) >= (0,) * dims])

    def count(batches):
        edges = triangles = 0
        paired = lambda cols, starts, ends: cols[dims][starts] & ((ends - starts > 1) | (cols[-1][starts] > 1))  # noqa: E731  a cell's own places come first
        for cols in near.groups(batches, dims, paired):
            own, (*at, weight) = int(cols[dims].sum()), cols[dims + 1 :]
            if own:
                found = near.cliques_of(at, weight, own, square)
                edges, triangles = edges + found[0], triangles + found[1]
        yield pa.RecordBatch.from_pydict({"dim": pa.array([1, 2], pa.int32()), "n": pa.array([edges, triangles], pa.int64())})

    return dealt.repartition(tasks, *keys).sortWithinPartitions(*keys, F.desc("own")).mapInArrow(count, "dim int, n long")


def _counts_of_repeated_ids(points: DataFrame, radius: float, axes: tuple[str, ...], tasks: int) -> DataFrame:
    """``dim, n``: edges and triangles with an end among the ids of several points (column ``again``), as SQL joins edges by ids.

    Each such id gathers its neighbours with the number of edges to them and all their points; a triangle is counted at
    its least such id. Rows follow the edges at these ids.
    """
    keys, square, dims = [f"c{i}" for i in range(len(axes))], near.longest_square(radius), len(axes)
    placed = points.select("*", *P.cell_keys(radius, axes))
    ends = P.shifted(placed.filter("again"), list(itertools.product((-1, 0, 1), repeat=dims)))
    met = ends.alias("p").join(placed.alias("q"), [F.col(f"p.{k}") == F.col(f"q.{k}") for k in keys])
    met = met.filter((F.col("q.pid") > F.col("p.pid")) | (~F.col("q.again") & (F.col("q.pid") < F.col("p.pid")))).filter(distance("p", "q", axes) <= radius)
    stars = cut(met.groupBy(F.col("p.pid").alias("a"), F.col("q.pid").alias("pid")).agg(F.count(F.lit(1)).alias("times")))
    dealt = stars.join(points, "pid").select("a", "pid", "times", *axes)

    def count(batches):
        triangles = sum(near.facing(at, node, times, square) for _, node, times, *at in near.groups(batches, 1))
        yield pa.RecordBatch.from_pydict({"dim": pa.array([2], pa.int32()), "n": pa.array([triangles], pa.int64())})

    triples = dealt.repartition(tasks, "a").sortWithinPartitions("a").mapInArrow(count, "dim int, n long")
    return stars.select(F.lit(1).alias("dim"), F.col("times").alias("n")).unionByName(triples)


def rips_cell_counts(points: DataFrame, radius: float, axes: tuple[str, ...] = P.AXES) -> DataFrame:
    """``cell_counts`` of the points' radius edges and triangles, from the points; no edge or triangle becomes a row.

    Points and edges have a row even if there are none, triangles have one if there are some.
    """
    if radius <= 0:
        raise ValueError("radius must be positive")
    tasks = min(20_000, max(8, points.count() // 512))
    placed = points.filter("pid IS NOT NULL").select("pid", *axes)
    for c in axes:
        placed = placed.filter(F.abs(F.col(c)) < F.lit(math.inf))  # others have no edge
    none = points.sparkSession.range(2).select(F.col("id").cast("int").alias("dim"), F.lit(0).cast("long").alias("n"))
    parts = none.unionByName(points.select(F.lit(0).alias("dim"), F.lit(1).cast("long").alias("n")))
    if P.repeated_ids(placed):
        ids = placed.groupBy("pid").agg((F.count(F.lit(1)) > 1).alias("again"))
        placed = cut(placed.join(ids, "pid"))
        parts = parts.unionByName(_counts_of_repeated_ids(placed, radius, axes, tasks))
        placed = placed.filter(~F.col("again"))
    parts = parts.unionByName(_counts_of_single_ids(placed, radius, axes, tasks))
    return parts.groupBy("dim").agg(F.sum("n").alias("n_cells")).filter("dim < 2 OR n_cells > 0")
