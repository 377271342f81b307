"""Filtration families by name: built-in kinds and a registry for own ones.

A family takes (points or graph tables, parameters) and returns a cell table ``dim, verts, g1[, g2]``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import simplex_value
from . import complexes, graphs
from . import points as P


@dataclass(frozen=True)
class Family:
    build: Callable[..., DataFrame]
    arity: int
    required: tuple[str, ...] = ()
    defaults: dict = field(default_factory=dict)


_FAMILIES: dict[str, Family] = {}


def register(kind: str, arity: int, required: tuple[str, ...] = (), **defaults) -> Callable:
    """Adds a family; its builder gets the data and the checked parameters."""

    def put(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if kind in _FAMILIES:
            raise ValueError(f"{kind} is registered")
        _FAMILIES[kind] = Family(build, arity, required, defaults)
        return build

    return put


def available() -> list[str]:
    return sorted(_FAMILIES)


def signature(kind: str) -> dict:
    f = _FAMILIES[kind]
    return {"kind": kind, "arity": f.arity, "required": f.required, "defaults": dict(f.defaults)}


def build(kind: str, data: DataFrame, **params) -> DataFrame:
    """Checks names and required parameters, then builds the cells."""
    if kind not in _FAMILIES:
        raise ValueError(f"unknown filtration {kind}; there are {available()}")
    f = _FAMILIES[kind]
    unknown = set(params) - set(f.defaults) - set(f.required)
    missing = [p for p in f.required if params.get(p) is None]
    if unknown or missing:
        raise ValueError(f"{kind}: unknown {sorted(unknown)}, missing {missing}")
    return f.build(data, **(f.defaults | params))


def _valued(data: DataFrame, values: DataFrame, radius: float, max_dim: int, agg: str = "max") -> DataFrame:
    if max_dim not in (1, 2):
        raise ValueError("max_dim must be 1 or 2")
    return complexes.function_cells(values, P.radius_edges(data, radius), agg, with_triangles=max_dim == 2)


@register("rips", 1, ("radius",), max_dim=1)
def rips(data: DataFrame, radius: float, max_dim: int) -> DataFrame:
    return _valued(data, data.select("pid", F.lit(0.0).alias("value")), radius, max_dim).drop("g2")


@register("rips_density", 2, ("radius",), max_dim=1, density_k=2, start=0.05)
def rips_density(data: DataFrame, radius: float, max_dim: int, density_k: int, start: float) -> DataFrame:
    return _valued(data, P.knn_distance(data, density_k, start), radius, max_dim)


@register("rips_codensity", 2, ("radius",), max_dim=1, dtm_mass=0.1, start=0.05)
def rips_codensity(data: DataFrame, radius: float, max_dim: int, dtm_mass: float, start: float) -> DataFrame:
    return _valued(data, P.dtm(data, dtm_mass, start), radius, max_dim)


@register("rips_lowerstar", 2, ("radius",), max_dim=1, coord=1)
def rips_lowerstar(data: DataFrame, radius: float, max_dim: int, coord: int) -> DataFrame:
    return _valued(data, data.select("pid", F.col(P.AXES[coord - 1]).alias("value")), radius, max_dim)


@register("function_rips", 2, ("radius", "value"), max_dim=1, agg="max")
def function_rips(data: DataFrame, radius: float, value: str, max_dim: int, agg: str) -> DataFrame:
    return _valued(data, data.select("pid", F.col(value).cast("double").alias("value")), radius, max_dim, agg)


@register("landmark_rips", 1, ("radius", "landmarks"), max_dim=1)
def landmark_rips(data: DataFrame, radius: float, landmarks: DataFrame, max_dim: int) -> DataFrame:
    return rips(data.join(landmarks, "pid", "left_semi"), radius, max_dim)


@register("degree_rips", 2, ("radius",), max_dim=1)
def degree_rips(data: DataFrame, radius: float, max_dim: int) -> DataFrame:
    edges = P.radius_edges(data, radius)
    return complexes.function_cells(graphs.degrees(data, edges).select("pid", F.col("value").cast("double").alias("value")), edges, with_triangles=max_dim == 2)


@register("core", 2, ("radius",), value=None)
def core(data: DataFrame, radius: float, value: str | None) -> DataFrame:
    """Vertices and edges only: (greatest value, least core number); values default to 0."""
    edges = P.radius_edges(data, radius)
    core_of = graphs.core_numbers(data, edges).select("pid", F.col("value").cast("double").alias("core"))
    own = data.select("pid", (F.col(value).cast("double") if value else F.lit(0.0)).alias("f")).join(core_of, "pid")
    one = edges.join(own.select(F.col("pid").alias("u"), F.col("f").alias("f1"), F.col("core").alias("c1")), "u").join(own.select(F.col("pid").alias("v"), F.col("f").alias("f2"), F.col("core").alias("c2")), "v")
    zero = own.select(F.lit(0).alias("dim"), F.array("pid").alias("verts"), F.col("f").alias("g1"), F.col("core").alias("g2"))
    return zero.unionByName(one.select(F.lit(1).alias("dim"), F.array("u", "v").alias("verts"), F.greatest("f1", "f2").alias("g1"), F.least("c1", "c2").alias("g2")))


@register("rhomboid", 2, ("radius", "value"), max_dim=1)
def rhomboid(data: DataFrame, radius: float, value: str, max_dim: int) -> DataFrame:
    """(least, greatest) of the vertices' values."""
    v = data.select("pid", F.col(value).cast("double").alias("value"))
    low = _valued(data, v, radius, max_dim, "min").select("dim", "verts", F.col("g2").alias("low"))
    high = _valued(data, v, radius, max_dim, "max").select("verts", F.col("g2").alias("high"))
    return low.join(high, "verts").select("dim", "verts", F.col("low").alias("g1"), F.col("high").alias("g2"))


@register("graph_weight_threshold", 1, ("edges",), lift="graph", weight="w")
def graph_weight_threshold(data: DataFrame, edges: DataFrame, lift: str, weight: str) -> DataFrame:
    """Vertices at 0, edges (u < v) at their weight; lift "clique" adds triangles at their largest edge."""
    if lift not in ("graph", "clique"):
        raise ValueError("lift must be graph or clique")
    e = edges.select("u", "v", F.col(weight).cast("double").alias("d"))
    cells = data.select(F.lit(0).alias("dim"), F.array("pid").alias("verts"), F.lit(0.0).alias("g1"))
    cells = cells.unionByName(e.select(F.lit(1).alias("dim"), F.array("u", "v").alias("verts"), F.col("d").alias("g1")))
    if lift == "clique":
        cells = cells.unionByName(complexes.triangles(e).select(F.lit(2).alias("dim"), F.array("a", "b", "c").alias("verts"), F.col("d").alias("g1")))
    return cells


@register("graph_function_geodesic", 2, ("edges", "sources", "value"), weight=None, agg="max")
def graph_function_geodesic(data: DataFrame, edges: DataFrame, sources: DataFrame, value: str, weight: str | None, agg: str) -> DataFrame:
    """(distance to the nearest source, own value) of every vertex; edges aggregate their ends in both."""
    far = graphs.geodesic(data, edges, sources, weight).withColumnRenamed("value", "far")
    own = data.select("pid", F.col(value).cast("double").alias("own")).join(far, "pid")
    ends = lambda c: own.select(F.col("pid").alias(c), F.col("far").alias(f"far_{c}"), F.col("own").alias(f"own_{c}"))
    one = edges.select("u", "v").join(ends("u"), "u").join(ends("v"), "v")
    zero = own.select(F.lit(0).alias("dim"), F.array("pid").alias("verts"), F.col("far").alias("g1"), F.col("own").alias("g2"))
    grade = lambda c: simplex_value(agg, F.col(f"{c}_u"), F.col(f"{c}_v"))
    return zero.unionByName(one.select(F.lit(1).alias("dim"), F.array("u", "v").alias("verts"), grade("far").alias("g1"), grade("own").alias("g2")))


@register("wing_vein", 2, ("edges", "bbox"), grid=(32, 32))
def wing_vein(data: DataFrame, edges: DataFrame, bbox: tuple[float, float, float, float], grid: tuple[int, int]) -> DataFrame:
    """``dim, verts, g1, g2``: a drawn graph (``pid, x, y`` and ``u, v``) sampled on a grid over bbox = (x0, x1, y0, y1).

    A sample's grades are minus its distance to the nearest vertex and its distance to the nearest edge, a cell's the
    greatest of its corners'; by custom the first axis is read downwards. Every vertex and edge meets the samples, a
    parameter's number of them, and minima are taken before rows move.
    """
    nx, ny = grid
    x0, x1, y0, y1 = map(float, bbox)
    at = lambda lo, hi, n, k: F.lit(lo) + k * F.lit((hi - lo) / max(n - 1, 1))

    def sampled(rows: DataFrame) -> DataFrame:
        k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nx * ny - 1).cast("long"))).alias("k")
        return rows.select("*", k).withColumn("px", at(x0, x1, nx, F.floor(F.col("k") / ny))).withColumn("py", at(y0, y1, ny, F.col("k") % ny))

    ends = lambda c: data.select(F.col("pid").alias(c), F.col("x").cast("double").alias(f"x{c}"), F.col("y").cast("double").alias(f"y{c}"))
    near = sampled(ends("u")).groupBy("k").agg((F.lit(0.0) - F.min(F.hypot(F.col("px") - F.col("xu"), F.col("py") - F.col("yu")))).alias("g1"))
    dx, dy = F.col("xv") - F.col("xu"), F.col("yv") - F.col("yu")
    t = F.coalesce(F.try_divide(dx * (F.col("px") - F.col("xu")) + dy * (F.col("py") - F.col("yu")), dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    side = sampled(edges.select("u", "v").join(ends("u"), "u").join(ends("v"), "v")).groupBy("k").agg(F.min(F.hypot(F.col("px") - F.col("xu") - t * dx, F.col("py") - F.col("yu") - t * dy)).alias("g2"))
    both = near.join(side, "k").select(F.floor(F.col("k") / ny).cast("long").alias("i"), (F.col("k") % ny).alias("j"), "g1", "g2")
    names = ["dim", "i", "j", "di", "dj"]
    one, two = (complexes.cubical_cells(both.select("i", "j", F.col(g).alias("value"))).select(*names, F.col("value").alias(g)) for g in ("g1", "g2"))
    corner = lambda di, dj: (F.col("i") + di) * ny + F.col("j") + dj
    verts = F.array_distinct(F.array(corner(0, 0), corner(0, F.col("dj")), corner(F.col("di"), 0), corner(F.col("di"), F.col("dj"))))
    return one.join(two, names).select("dim", F.array_sort(verts).alias("verts"), "g1", "g2")


@register("graded", 0)
def graded(data: DataFrame) -> DataFrame:
    """Cells with grades of their own (``dim, verts, g1[, g2...]``), as they are."""
    missing = {"dim", "verts", "g1"} - set(data.columns)
    if missing:
        raise ValueError(f"graded cells lack {sorted(missing)}")
    return data
