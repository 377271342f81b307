"""Lines through a two-parameter grid: chains of grid points, restrictions and weighted families of slices."""

from __future__ import annotations

from itertools import product
from math import gcd, pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import direction_weight, kernel


def directions(max_den: int = 8, include_axes: bool = False) -> list[tuple[int, int]]:
    """Coprime (a, b) up to ``max_den``, by slope."""
    low = 0 if include_axes else 1
    found = [(a, b) for a in range(low, max_den + 1) for b in range(low, max_den + 1) if gcd(a, b) == 1]
    return sorted(found, key=lambda d: d[1] / d[0] if d[0] else float("inf"))


def family(spark, dirs: list[tuple[float, float]], offsets: list[tuple[float, float]], scheme: str = "lesnick_l1") -> DataFrame:
    """``slice, dx, dy, x0, y0, weight``: every direction at every base point; directions are scaled to L1 length 1."""
    rows = [(i * len(offsets) + k, dx / (abs(dx) + abs(dy)), dy / (abs(dx) + abs(dy)), float(x), float(y)) for i, (dx, dy) in enumerate(dirs) for k, (x, y) in enumerate(offsets)]
    df = spark.createDataFrame(rows, "slice long, dx double, dy double, x0 double, y0 double")
    return df.withColumn("weight", direction_weight(F.col("dx"), F.col("dy"), scheme))


def chains(lines: DataFrame, xs: list[float], ys: list[float], tmin: float, tmax: float, steps: int) -> DataFrame:
    """``slice, pos, i, j, t``: grid cells met along each line, consecutive repeats and places below the grid left out.

    ``i`` and ``j`` are positions (from 1) of the last axis value at or below the point; axes are parameters.
    """
    t = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.lit(tmin) + k * F.lit((tmax - tmin) / max(steps - 1, 1))))
    at = lambda c, axis: F.size(F.filter(F.array(*(F.lit(float(v)) for v in axis)), lambda v: v <= c))
    rows = lines.select("slice", "dx", "dy", "x0", "y0", t.alias("t"))
    rows = rows.select("slice", "t", at(F.col("x0") + F.col("t") * F.col("dx"), xs).alias("i"), at(F.col("y0") + F.col("t") * F.col("dy"), ys).alias("j")).filter("i > 0 and j > 0")
    order = Window.partitionBy("slice").orderBy("t")
    fresh = F.lag("i").over(order).isNull() | (F.lag("i").over(order) != F.col("i")) | (F.lag("j").over(order) != F.col("j"))
    return rows.withColumn("fresh", fresh).filter("fresh").select("slice", F.row_number().over(order).alias("pos"), "i", "j", "t")


def restricted(chain: DataFrame, surface: DataFrame) -> DataFrame:
    """``slice, pos, t, value``: a grid table (``i, j, value``) along the chains."""
    return chain.join(surface, ["i", "j"]).select("slice", "pos", "t", "value")


def spread(items: list, n: int) -> list:
    """At most ``n`` of the items, evenly spread, both ends included (rounded, ties to even)."""
    if n < 1:
        raise ValueError("n must be positive")
    if len(items) <= n:
        return list(items)
    last = len(items) - 1
    return [items[p - 1] for p in dict.fromkeys(round(1 + k * last / max(n - 1, 1)) for k in range(n))]


def default_directions(axes: int = 2, n: int = 16, max_den: int = 8, include_axes: bool = False, scale: str = "l1") -> list[tuple[float, ...]]:
    """Primitive directions with entries up to ``max_den``, evenly thinned to ``n``; scaled to L1 or Linf length 1, or whole ("none")."""
    if axes < 1 or max_den < 1:
        raise ValueError("axes and max_den must be positive")
    if axes == 1:
        found = [(1,)]
    elif axes == 2:
        found = directions(max_den, include_axes)
    else:
        low = 0 if include_axes else 1
        found = sorted((v for v in product(range(low, max_den + 1), repeat=axes) if gcd(*v) == 1), key=lambda v: [x / sum(v) for x in v])
    size = {"l1": sum, "linf": max, "none": lambda v: 1}[scale]
    return [tuple(x / size(v) for x in v) if scale != "none" else v for v in spread(found, n)]


def bounding_box(reps: DataFrame, axes: tuple[str, ...], margin: float = 0.05) -> DataFrame:
    """One row ``lo_<axis>, hi_<axis>``: the extent of representative points, widened by a share of each side."""
    ends = reps.agg(*(f(c).cast("double").alias(f"{n}_{c}") for c in axes for n, f in (("lo", F.min), ("hi", F.max))))
    return _widened(ends, axes, margin, 0.0)


def window(reps: DataFrame, axes: tuple[str, ...], margin: float = 0.05, padding: float = 0.0, whole: bool = False) -> DataFrame:
    """As ``bounding_box``; a side without length gets 1 on either end first, and ``whole`` rounds outwards."""
    if margin < 0 or padding < 0:
        raise ValueError("margin and padding can't be negative")
    ends = bounding_box(reps, axes, 0.0)
    for c in axes:
        flat = F.abs(F.col(f"hi_{c}") - F.col(f"lo_{c}")) < 1e-12
        more = F.when(flat, 1.0).otherwise(0.0)
        ends = ends.withColumn("_m", more).withColumn(f"lo_{c}", F.col(f"lo_{c}") - F.col("_m")).withColumn(f"hi_{c}", F.col(f"hi_{c}") + F.col("_m")).drop("_m")
    ends = _widened(ends, axes, margin, padding)
    if whole:
        ends = ends.select(*(f(f"{n}_{c}").cast("double").alias(f"{n}_{c}") for c in axes for n, f in (("lo", F.floor), ("hi", F.ceil))))
    return ends


def _widened(ends: DataFrame, axes: tuple[str, ...], margin: float, padding: float) -> DataFrame:
    out = []
    for c in axes:
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        more = (hi - lo) * F.lit(float(margin)) + F.lit(float(padding))
        out += [(lo - more).alias(f"lo_{c}"), (hi + more).alias(f"hi_{c}")]
    return ends.select(*out)


def _steps(n: int) -> list[float]:
    return [k / (n - 1) for k in range(n)] if n > 1 else [0.0]


def default_offsets(box: DataFrame, axes: tuple[str, ...], n: int = 9) -> DataFrame:
    """``k`` and the axes: ``n`` points along the diagonal of each box."""
    rows = box.select("*", F.posexplode(F.array(*map(F.lit, _steps(n)))).alias("k", "s"))
    return rows.select("k", *((F.col(f"lo_{c}") + F.col("s") * (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).alias(c) for c in axes))


def offsets_along(box: DataFrame, axes: tuple[str, ...], direction: tuple[float, ...], n: int = 9) -> DataFrame:
    """``k`` and the axes: the box's centre shifted along a direction until its projection spans those of the corners."""
    length = sum(d * d for d in direction) ** 0.5
    if not length:
        raise ValueError("the direction must not be zero")
    unit = [d / length for d in direction]
    ends = lambda pick: sum((F.lit(u) * F.col(f"{pick(u)}_{c}") for u, c in zip(unit, axes, strict=True)), F.lit(0.0))
    centre = {c: (F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2 for c in axes}
    at = sum((F.lit(u) * centre[c] for u, c in zip(unit, axes, strict=True)), F.lit(0.0))
    low, high = ends(lambda u: "lo" if u >= 0 else "hi"), ends(lambda u: "hi" if u >= 0 else "lo")
    rows = box.select("*", low.alias("_low"), high.alias("_high"), at.alias("_at"), F.posexplode(F.array(*map(F.lit, _steps(n)))).alias("k", "s"))
    shift = F.col("_low") + F.col("s") * (F.col("_high") - F.col("_low")) - F.col("_at")
    return rows.select("k", *((centre[c] + shift * F.lit(u)).alias(c) for u, c in zip(unit, axes, strict=True)))


def offset_weight(low, high, spec: str | float = "uniform"):
    """Weight of an interval of offsets: 1, its length, or a number."""
    if spec in ("uniform", "none"):
        return F.lit(1.0)
    return (high - low).cast("double") if spec == "length" else F.lit(float(spec))


def sample_weight(k, n: int, spec: str = "uniform"):
    """Weight of the k-th (from 0) of n sampled offsets: 1, or a smooth window that falls to the ends."""
    if spec not in ("uniform", "none", "cosine"):
        raise ValueError(f"unknown weights {spec}")
    return F.sin(F.lit(pi) * (k + 0.5) / F.lit(float(n))) if spec == "cosine" else F.lit(1.0)


def collect(lines: DataFrame, offsets: int, spec: str = "uniform", normalize: bool = True) -> DataFrame:
    """A plan of slices: ``family``'s lines with weights of direction and offset multiplied, summing to 1 if asked.

    The weights' sum comes from one aggregate over the plan, a table of parameters.
    """
    rows = lines.withColumn("weight", F.col("weight") * sample_weight(F.col("slice") % offsets, offsets, spec))
    if not normalize:
        return rows
    total = rows.agg(F.sum("weight").alias("_total"))
    return rows.crossJoin(F.broadcast(total)).withColumn("weight", F.when(F.col("_total") > 0, F.col("weight") / F.col("_total")).otherwise(F.col("weight"))).drop("_total")  # one row


def slice_kernel(distances: DataFrame, weights: DataFrame, kind: str = "gaussian", sigma: float = 1.0, normalize: bool = True) -> DataFrame:
    """``kernel``: weighted mean (or sum) over slices of a Gaussian or Laplacian of the slice's distance (``slice, distance``)."""
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    rows = weights.join(distances, "slice").select("weight", kernel(F.col("distance"), kind, sigma).alias("k"))
    total = F.sum(F.col("weight") * F.col("k"))
    return rows.agg((total / F.sum("weight") if normalize else total).alias("kernel"))
