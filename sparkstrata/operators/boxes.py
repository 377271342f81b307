"""Geometry of convex boxes and of unions of unit squares, as expressions on their rows.

A box row has ``region`` and two arrays ``lo`` and ``hi`` of the same length (its corners, any dimension). A box
without extent in some axis has volume 0. A labelled image has ``i, j, region``, each pixel is a unit square.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def widths() -> Column:
    return F.zip_with("lo", "hi", lambda a, b: (b - a).cast("double"))


def centroid() -> Column:
    """Midpoint of the box."""
    return F.zip_with("lo", "hi", lambda a, b: ((a + b) / 2).cast("double"))


def _product(a: Column) -> Column:
    return F.aggregate(a, F.lit(1.0), lambda x, y: x * y)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def volume() -> Column:
    return _product(widths())


def _facet(k: Column) -> Column:
    """Measure of the two facets across axis ``k``: the product of the other widths."""
    return F.aggregate(F.sequence(F.lit(0), F.size("lo") - 1), F.lit(1.0), lambda x, i: F.when(i == k, x).otherwise(x * F.get(widths(), i)))


def boundary() -> Column:
    return 2.0 * _sum(F.transform(F.sequence(F.lit(0), F.size("lo") - 1), _facet))


def facet_count() -> Column:
    return 2 * F.size("lo")


def vertex_count() -> Column:
    return F.pow(F.lit(2), F.size("lo")).cast("int")


def breakdown(boxes: DataFrame) -> DataFrame:
    """``region, axis, side, measure``: each facet; side -1 at the low end, 1 at the high end."""
    rows = boxes.select("region", "lo", "hi", F.explode(F.sequence(F.lit(0), F.size("lo") - 1)).alias("axis"))
    return rows.select("region", "axis", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"), _facet(F.col("axis")).alias("measure"))


def chebyshev_radius() -> Column:
    """Radius of the largest ball inside, in any of the usual norms that reach facets along axes; its centre is the midpoint."""
    return F.array_min(widths()) / 2


def circumradius(metric: str = "L2") -> Column:
    """Radius of the least ball around, centred at the midpoint."""
    half = F.transform(widths(), lambda w: w / 2)
    if metric == "L2":
        return F.sqrt(_sum(F.transform(half, lambda w: w * w)))
    if metric == "L1":
        return _sum(half)
    if metric == "Linf":
        return F.array_max(half)
    raise ValueError(f"unknown metric {metric}")


def boundary_to_volume(s: Column, v: Column) -> Column:
    return F.when(v > 0, s / v).otherwise(F.when(s > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))


def isoperimetric(s: Column, v: Column, n: int, kind: str = "quotient") -> Column:
    """Volume against that of a ball of the same boundary; NaN without volume or boundary.

    ``quotient`` is 1 for a ball, ``ratio`` its inverse, ``deficit`` what it lacks to 1, ``planar`` its square for n = 2.
    """
    if n < 2 or (kind == "planar" and n != 2):
        raise ValueError("isoperimetric ratios need two dimensions (planar: exactly two)")
    if kind == "planar":
        out = 4 * math.pi * v / (s * s)
    else:
        unit = math.pi ** (n / 2) / math.gamma(n / 2 + 1)
        q = n * unit ** (1 / n) * F.pow(v, (n - 1) / n) / s
        out = {"quotient": q, "ratio": 1 / q, "deficit": 1 - q}[kind]
    return F.when((v > 0) & (s > 0), out).otherwise(F.lit(float("nan")))


def mean_width(n: int) -> Column:
    """Mean over all directions of the box's width, exactly."""
    return _sum(widths()) * (math.gamma(n / 2) / (math.sqrt(math.pi) * math.gamma((n + 1) / 2)))


def minkowski_functionals(boxes: DataFrame, n: int) -> DataFrame:
    """``region, volume, boundary_measure, mean_width``."""
    return boxes.select("region", volume().alias("volume"), boundary().alias("boundary_measure"), mean_width(n).alias("mean_width"))


def principal_directions(labels: DataFrame) -> DataFrame:
    """``region, mean_i, mean_j, lmax, lmin, angle``: centroid and covariance axes of each region's unit squares.

    ``angle`` is that of the first axis from the i axis in (-pi/2, pi/2]; 0 if both eigenvalues are equal.
    """
    s = labels.groupBy("region").agg(
        F.avg(F.col("i") + 0.5).alias("mean_i"), F.avg(F.col("j") + 0.5).alias("mean_j"), (F.var_pop("i") + 1 / 12).alias("a"), (F.var_pop("j") + 1 / 12).alias("b"), F.covar_pop("i", "j").alias("c")
    )
    half, gap = (F.col("a") + F.col("b")) / 2, F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, 2) + F.col("c") * F.col("c"))
    return s.select("region", "mean_i", "mean_j", (half + gap).alias("lmax"), (half - gap).alias("lmin"), F.when(gap > 0, F.atan2(2 * F.col("c"), F.col("a") - F.col("b")) / 2).otherwise(0.0).alias("angle"))


def anisotropy(lmax: Column, lmin: Column, kind: str = "ratio", epsilon: float = 0.0) -> Column:
    """Of the covariance's eigenvalues: ``ratio``, ``log_ratio``, ``normalized`` or ``eccentricity``; no extent is round."""
    low = F.greatest(lmin, F.lit(epsilon))
    out = {"ratio": lmax / low, "log_ratio": F.log(lmax / low), "normalized": (lmax - lmin) / (lmax + lmin + epsilon), "eccentricity": F.sqrt(F.greatest(1 - lmin / F.greatest(lmax, F.lit(epsilon)), F.lit(0.0)))}[kind]
    return F.when(lmax == 0, F.lit(1.0 if kind == "ratio" else 0.0)).otherwise(out)


def anisotropy_scores(directions: DataFrame, epsilon: float = 0.0) -> DataFrame:
    kinds = ("ratio", "log_ratio", "normalized", "eccentricity")
    return directions.select("region", *(anisotropy(F.col("lmax"), F.col("lmin"), k, epsilon).alias(k) for k in kinds))


def outline(labels: DataFrame) -> DataFrame:
    """``region, boundary``: the length of each region's outline, from the sides that its squares share."""
    right = labels.select((F.col("i") - 1).alias("i"), "j", "region")
    up = labels.select("i", (F.col("j") - 1).alias("j"), "region")
    inner = labels.join(right, ["i", "j", "region"]).select("region").unionByName(labels.join(up, ["i", "j", "region"]).select("region"))
    n, shared = labels.groupBy("region").agg(F.count(F.lit(1)).alias("n")), inner.groupBy("region").agg(F.count(F.lit(1)).alias("shared"))
    return n.join(shared, "region", "left").select("region", (4.0 * F.col("n") - 2.0 * F.coalesce("shared", F.lit(0))).alias("boundary"))
