"""Statistics of labelled regions: weights, bounding boxes, adjacency, interfaces.

A region table has ``region, weight, dim`` and box columns; an adjacency table ``r, s, measure`` with r < s. All are
grouped sums and equi-joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dim_stats(table: DataFrame) -> DataFrame:
    """Total weight, integrated dimension, weighted mean and variance; NaN moments if the total is 0."""
    s = table.agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("dim")).alias("wd"), F.sum(F.col("weight") * F.col("dim") * F.col("dim")).alias("wdd"))
    mean = F.col("wd") / F.col("w")
    nan = F.lit(float("nan"))
    return s.select(F.col("w").alias("total_measure"), F.col("wd").alias("integrated_mass"), F.when(F.col("w") == 0, nan).otherwise(mean).alias("mean_dim"), F.when(F.col("w") == 0, nan).otherwise(F.col("wdd") / F.col("w") - mean * mean).alias("var_dim"))


def dim_norm(table: DataFrame, p: float = 2.0) -> DataFrame:
    """(sum w |dim|^p)^(1/p); for inf the largest over all regions, whatever their weight."""
    if p == float("inf"):
        return table.agg(F.max(F.abs("dim")).cast("double").alias("norm"))
    return table.agg(F.pow(F.sum(F.col("weight") * F.pow(F.abs("dim").cast("double"), p)), 1.0 / p).alias("norm"))


def by_dimension(table: DataFrame) -> DataFrame:
    return table.groupBy("dim").agg(F.sum("weight").alias("measure"))


def support_measure(table: DataFrame, min_dim: int = 1) -> DataFrame:
    return table.agg(F.coalesce(F.sum(F.when(F.col("dim") >= min_dim, F.col("weight"))), F.lit(0.0)).alias("measure"))


def support_bbox(table: DataFrame, min_dim: int = 1) -> DataFrame:
    return table.filter(F.col("dim") >= min_dim).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def support_diameter(table: DataFrame, metric: str = "L2", min_dim: int = 1) -> DataFrame:
    """Diameter of the support's bounding box."""
    dx, dy = (F.col("x1") - F.col("x0")).cast("double"), (F.col("y1") - F.col("y0")).cast("double")
    d = {"L1": dx + dy, "L2": F.sqrt(dx * dx + dy * dy), "Linf": F.greatest(dx, dy)}[metric]
    return support_bbox(table, min_dim).select(d.alias("diameter"))


def weight_entropy(table: DataFrame, base: float | None = None) -> DataFrame:
    """Shannon entropy of the weights' shares; 0 if the total is 0."""
    w = F.col("weight")
    s = table.filter("weight > 0").agg(F.sum(w).alias("s"), F.sum(w * F.log(w)).alias("sl"))
    h = F.log("s") - F.col("sl") / F.col("s")
    return s.select(F.coalesce(h / F.log(F.lit(base)) if base else h, F.lit(0.0)).alias("entropy"))


def aspect_ratios(table: DataFrame) -> DataFrame:
    """``region, aspect``: largest over least positive width; 1 for a point, 0 when empty."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    least = F.least(F.when(dx > 0, dx), F.when(dy > 0, dy))
    return table.select("region", F.when(F.col("x0").isNull(), F.lit(0.0)).when(least.isNull(), F.lit(1.0)).otherwise(F.greatest(dx, dy) / least).alias("aspect"))


def aspect_stats(table: DataFrame) -> DataFrame:
    rows = table.join(aspect_ratios(table), "region").filter("weight > 0")
    return rows.agg(F.sum("weight").alias("total_measure"), (F.sum(F.col("weight") * F.col("aspect")) / F.sum("weight")).alias("mean_aspect"), F.min("aspect").alias("min_aspect"), F.max("aspect").alias("max_aspect"))


def histogram_by_dim(table: DataFrame, bins: int, lo: float, hi: float) -> DataFrame:
    """``dim, bin, n``: even bins of the weights; the last bin holds its upper end; weights outside are left out."""
    at = F.least(F.floor((F.col("weight") - lo) / F.lit((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return table.filter(F.col("weight").between(lo, hi)).groupBy("dim", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def grid_adjacency(labels: DataFrame) -> DataFrame:
    """``r, s, measure``: number of grid sides that two regions share. ``labels``: i, j, region."""
    right = labels.select((F.col("i") - 1).alias("i"), "j", F.col("region").alias("other"))
    up = labels.select("i", (F.col("j") - 1).alias("j"), F.col("region").alias("other"))
    both = labels.join(right, ["i", "j"]).select("region", "other").unionByName(labels.join(up, ["i", "j"]).select("region", "other"))
    return both.filter("region <> other").groupBy(F.least("region", "other").alias("r"), F.greatest("region", "other").alias("s")).agg(F.count(F.lit(1)).alias("measure"))


def _with_dims(adjacency: DataFrame, table: DataFrame) -> DataFrame:
    d = lambda c, out: table.select(F.col("region").alias(c), F.col("dim").alias(out))
    return adjacency.join(d("r", "d1"), "r").join(d("s", "d2"), "s")


def interface_measure(adjacency: DataFrame) -> DataFrame:
    return adjacency.agg(F.coalesce(F.sum("measure"), F.lit(0)).alias("measure"))


def interface_by_dims(adjacency: DataFrame, table: DataFrame) -> DataFrame:
    return _with_dims(adjacency, table).groupBy(F.least("d1", "d2").alias("low"), F.greatest("d1", "d2").alias("high")).agg(F.sum("measure").alias("measure"))


def interface_changes(adjacency: DataFrame, table: DataFrame) -> DataFrame:
    return _with_dims(adjacency, table).filter("d1 <> d2").agg(F.coalesce(F.sum("measure"), F.lit(0)).alias("measure"))


def hilbert_distance(a: DataFrame, b: DataFrame, norm: str = "L1") -> DataFrame:
    """Distance of two dimension tables (``region, dim``); missing regions have dimension 0."""
    gap = F.abs(F.coalesce(F.col("p.dim"), F.lit(0)) - F.coalesce(F.col("q.dim"), F.lit(0))).cast("double")
    agg = {"L1": F.sum(gap), "L2": F.sqrt(F.sum(gap * gap)), "Linf": F.max(gap)}[norm]
    return a.alias("p").join(b.alias("q"), "region", "full").agg(agg.alias("distance"))
