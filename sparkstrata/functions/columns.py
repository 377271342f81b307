"""Column expressions that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(a: str, b: str, axes: tuple[str, ...]) -> Column:
    """Euclidean distance of two aliased tables' coordinates, summed in axis order."""
    total = reduce(lambda x, y: x + y, ((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in axes))
    return F.sqrt(total)


def simplex_value(agg: str, *values: Column) -> Column:
    """A simplex's value from its vertices' values: max, min, sum or mean."""
    if agg == "max":
        return F.greatest(*values)
    if agg == "min":
        return F.least(*values)
    total = reduce(lambda x, y: x + y, values)
    if agg == "sum":
        return total
    if agg == "mean":
        return total / F.lit(float(len(values)))
    raise ValueError(f"unknown aggregate {agg}")


def quantised(grade: Column, step: float) -> Column:
    """Grid index of a grade, ties to even; the grade itself is index * step."""
    return F.rint(grade / F.lit(float(step))).cast("long")


def sign(dim: Column) -> Column:
    return F.when(dim % 2 == 0, 1).otherwise(-1)


def tent(birth: Column, death: Column, t: Column) -> Column:
    """min(t - birth, death - t), not below 0."""
    return F.greatest(F.least(t - birth, death - t), F.lit(0.0))


def direction_weight(x: Column, y: Column, scheme: str = "lesnick_l1") -> Column:
    """Weight of a direction: its least component after L1 or Linf scaling, or 1."""
    if scheme == "lesnick_l1":
        return F.least(F.abs(x), F.abs(y)) / (F.abs(x) + F.abs(y))
    if scheme == "lesnick_linf":
        return F.least(F.abs(x), F.abs(y)) / F.greatest(F.abs(x), F.abs(y))
    if scheme == "none":
        return F.lit(1.0)
    raise ValueError(f"unknown scheme {scheme}")


def kernel(distance_: Column, kind: str, sigma: float) -> Column:
    """Gaussian exp(-d^2 / 2 sigma^2) or Laplacian exp(-d / sigma)."""
    if kind == "gaussian":
        return F.exp(-(distance_ * distance_) / F.lit(2.0 * sigma * sigma))
    if kind == "laplacian":
        return F.exp(-distance_ / F.lit(float(sigma)))
    raise ValueError(f"unknown kernel {kind}")
