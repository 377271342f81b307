"""Supports of dimension tables, and summaries of a module's size and of its regions' adjacency.

A region table has ``region, weight, dim``, an adjacency table ``r, s, measure`` with r < s. Components and distances
run by rounds over tables (see ``graphs``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import cut
from . import graphs as G
from . import regions as R


def mask(table: DataFrame, min_dim: int = 1) -> DataFrame:
    """``region, inside``."""
    return table.select("region", (F.col("dim") >= min_dim).alias("inside"))


def vertices(table: DataFrame, min_dim: int = 1) -> DataFrame:
    return table.filter(F.col("dim") >= min_dim).select("region")


def graph(table: DataFrame, adjacency: DataFrame, min_dim: int = 1) -> tuple[DataFrame, DataFrame]:
    """(``pid``, ``u, v``) of the support."""
    inside = vertices(table, min_dim).withColumnRenamed("region", "pid")
    edges = adjacency.select(F.col("r").alias("u"), F.col("s").alias("v"))
    for c in ("u", "v"):
        edges = edges.join(inside.select(F.col("pid").alias(c)), c, "left_semi")
    return inside, edges.select("u", "v")


def components(table: DataFrame, adjacency: DataFrame, min_dim: int = 1) -> DataFrame:
    """``region, component``: the least region of each region's component of the support."""
    return G.components(*graph(table, adjacency, min_dim)).select(F.col("pid").alias("region"), F.col("root").alias("component"))


def hops(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``u, v, d``: hop distances within components, each vertex to all it reaches; one round a hop.

    The result has a row for each connected pair, so it is for graphs of regions, not of points.
    """
    arcs = cut(G.both_ways(edges).select("u", "v"))
    found = cut(vertices.select(F.col("pid").alias("u"), F.col("pid").alias("v"), F.lit(0).alias("d")))
    front, d = found, 0
    while True:
        d += 1
        step = front.select("u", F.col("v").alias("m")).join(arcs.select(F.col("u").alias("m"), "v"), "m").select("u", "v").distinct()
        front = cut(step.join(found.select("u", "v"), ["u", "v"], "left_anti").withColumn("d", F.lit(d)))
        if front.isEmpty():
            return found
        found = cut(found.unionByName(front))


def graph_diameter(table: DataFrame, adjacency: DataFrame, min_dim: int = 1) -> DataFrame:
    """``component, size, diameter``: the longest shortest path of each component of the support."""
    pids, edges = graph(table, adjacency, min_dim)
    roots = components(table, adjacency, min_dim)
    far = hops(pids, edges).groupBy(F.col("u").alias("region")).agg(F.max("d").alias("d"))
    return roots.join(far, "region").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.max("d").alias("diameter"))


def measure_by_value(values: DataFrame, table: DataFrame) -> DataFrame:
    """``value, measure``: weight of the regions of each value. ``values``: region, value."""
    return values.join(table.select("region", "weight"), "region").groupBy("value").agg(F.sum("weight").alias("measure"))


def vertex_set_measure(regions: DataFrame, table: DataFrame) -> DataFrame:
    """Weight of a set of regions; each counts once."""
    return table.join(regions.select("region"), "region", "left_semi").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("measure"))


def size_summary(table: DataFrame) -> DataFrame:
    """One row: totals, moments, support measure and ``by_dim``, the measures of all dimensions as a sorted array."""
    by_dim = table.groupBy("dim").agg(F.sum("weight").alias("measure")).agg(F.array_sort(F.collect_list(F.struct("dim", "measure"))).alias("by_dim"))  # a row for each dimension
    return R.dim_stats(table).crossJoin(R.support_measure(table).withColumnRenamed("measure", "support_measure")).crossJoin(by_dim)  # one row each


def samples_by_dim(table: DataFrame, value: str = "weight") -> DataFrame:
    """``dim, samples``: sorted values of the regions of each dimension. A dimension's regions are one array."""
    return table.groupBy("dim").agg(F.array_sort(F.collect_list(value)).alias("samples"))


def adjacency_stats(table: DataFrame, adjacency: DataFrame) -> DataFrame:
    """One row: regions, edges, components, their sizes downwards, and modularity by dimension."""
    pids = table.select(F.col("region").alias("pid"))
    edges = adjacency.select(F.col("r").alias("u"), F.col("s").alias("v"))
    sizes = G.components(pids, edges).groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    parts = sizes.agg(F.count(F.lit(1)).alias("n_components"), F.sort_array(F.collect_list("size"), asc=False).alias("component_sizes"))  # a row for each component
    m = adjacency.agg(F.count(F.lit(1)).alias("n_edges"))
    dims = table.select(F.col("region").alias("pid"), F.col("dim").alias("label"))
    both = G.both_ways(edges)
    ends = both.join(dims.withColumnRenamed("pid", "u"), "u").withColumnRenamed("label", "lu").join(dims.withColumnRenamed("pid", "v"), "v").withColumnRenamed("label", "lv")
    inside = ends.agg((F.sum(F.when(F.col("lu") == F.col("lv"), 1.0).otherwise(0.0)) / F.count(F.lit(1))).alias("inside"))
    share = ends.groupBy("lu").agg(F.count(F.lit(1)).cast("double").alias("k")).agg((F.sum(F.col("k") * F.col("k")) / F.pow(F.sum("k"), 2)).alias("share"))
    rows = table.agg(F.count(F.lit(1)).alias("n_regions"))
    out = rows.crossJoin(m).crossJoin(parts).crossJoin(inside).crossJoin(share)  # one row each
    return out.select("n_regions", "n_edges", "n_components", "component_sizes", F.coalesce(F.col("inside") - F.col("share"), F.lit(0.0)).alias("modularity"))


def asymptotics(labels: DataFrame, table: DataFrame, scales: list[float], width: float, height: float) -> DataFrame:
    """``scale, measure, mass, interface, slope``: sizes inside growing windows [0, scale * width) x [0, scale * height).

    ``slope`` is the exponent of the measure's growth, the least-squares slope of the logarithms.
    """
    scale = F.explode(F.array(*(F.lit(float(s)) for s in scales)))
    rows = labels.join(table.select("region", "dim"), "region").withColumn("scale", scale)
    inside = rows.filter((F.col("i") < F.col("scale") * width) & (F.col("j") < F.col("scale") * height))
    size = inside.groupBy("scale").agg(F.count(F.lit(1)).cast("double").alias("measure"), F.sum("dim").cast("double").alias("mass"))
    touch = None
    for di, dj in ((1, 0), (0, 1)):
        moved = inside.select("scale", (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("region").alias("other"))
        one = inside.join(moved, ["scale", "i", "j"]).filter("region <> other").select("scale")
        touch = one if touch is None else touch.unionByName(one)
    sides = touch.groupBy("scale").agg(F.count(F.lit(1)).cast("double").alias("interface"))
    slope = size.agg(F.regr_slope(F.log("measure"), F.log("scale")).alias("slope"))
    return size.join(sides, "scale", "left").crossJoin(slope).select("scale", "measure", "mass", F.coalesce("interface", F.lit(0.0)).alias("interface"), "slope")  # one row
