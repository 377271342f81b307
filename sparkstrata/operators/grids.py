"""Surfaces and signed measures on a finite grid.

A measure is sparse (``i, j, w``), a surface dense (``i, j, value``) on the product of two axis tables. Measures are sums
of signs at births and stay small; a surface is asked for only where it is needed. Prefix sums run along one axis in
groups of the other, so no group holds the grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import kernel, sign


def euler_measure(cells: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """``i, j, w``: sum of (-1)^dim over the cells born there; zeros are dropped. No surface is built."""
    return cells.groupBy(F.col(i).alias("i"), F.col(j).alias("j")).agg(F.sum(sign(F.col("dim"))).alias("w")).filter("w <> 0")


def surface(measure: DataFrame) -> DataFrame:
    """Prefix sums of a measure on the grid of its own coordinates."""
    rows, cols = measure.select("i").distinct(), measure.select("j").distinct()
    # Sum along j only where a row has mass, then let each row's steps run down i.
    along = Window.partitionBy("i").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("j").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    grid = rows.crossJoin(cols)  # the grid itself: both sides are axes
    dense = grid.join(measure, ["i", "j"], "left").select("i", "j", F.coalesce("w", F.lit(0)).alias("w"))
    return dense.withColumn("w", F.sum("w").over(along)).select("i", "j", F.sum("w").over(down).alias("value"))


def mobius(values: DataFrame) -> DataFrame:
    """Iterated differences of a surface; the inverse of ``surface``. Zeros are dropped."""
    along, down = Window.partitionBy("i").orderBy("j"), Window.partitionBy("j").orderBy("i")
    once = values.withColumn("w", F.col("value") - F.coalesce(F.lag("value").over(along), F.lit(0)))
    return once.select("i", "j", (F.col("w") - F.coalesce(F.lag("w").over(down), F.lit(0))).alias("w")).filter("w <> 0")


def truncated(measure: DataFrame, max_terms: int, least: int = 0) -> DataFrame:
    """The terms of largest weight; ties by place. A top-k report."""
    return measure.filter(F.abs("w") >= least).orderBy(F.abs("w").desc(), "i", "j").limit(max_terms)


def distance(a: DataFrame, b: DataFrame, order: float = 1.0) -> DataFrame:
    """L^order distance of two surfaces on one grid; inf takes the largest difference."""
    gap = F.abs(F.coalesce(F.col("p.value"), F.lit(0)) - F.coalesce(F.col("q.value"), F.lit(0))).cast("double")
    both = a.alias("p").join(b.alias("q"), ["i", "j"], "full")
    if order == float("inf"):
        return both.agg(F.max(gap).alias("distance"))
    return both.agg(F.pow(F.sum(F.pow(gap, order)), 1.0 / order).alias("distance"))


def measure_kernel(a: DataFrame, b: DataFrame, sigma: float, kind: str = "gaussian") -> DataFrame:
    """Sum of w w' k(x, y) over all terms. They meet in cells beyond whose neighbours the kernel is 0 in doubles."""
    reach = {"gaussian": 39.0, "laplacian": 746.0}[kind]
    side = max(1.0, reach * sigma)
    cell = lambda c: F.floor(F.col(c) / F.lit(side))
    shift = F.explode(F.array(*(F.lit(s) for s in (-1, 0, 1))))
    left = a.select(F.col("i").alias("i1"), F.col("j").alias("j1"), F.col("w").alias("w1"), cell("i").alias("ci"), cell("j").alias("cj")).withColumn("s", shift).withColumn("ci", F.col("ci") + F.col("s")).withColumn("s", shift).withColumn("cj", F.col("cj") + F.col("s"))
    right = b.select(F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("w").alias("w2"), cell("i").alias("ci"), cell("j").alias("cj"))
    d = F.sqrt(((F.col("i1") - F.col("i2")) * (F.col("i1") - F.col("i2")) + (F.col("j1") - F.col("j2")) * (F.col("j1") - F.col("j2"))).cast("double"))
    near = (F.abs(F.col("i1") - F.col("i2")) <= side) & (F.abs(F.col("j1") - F.col("j2")) <= side)
    return left.join(right, ["ci", "cj"]).filter(near).agg(F.sum(F.col("w1") * F.col("w2") * kernel(d, kind, sigma)).alias("kernel"))


def rank_of_bars(bars: DataFrame, length: int) -> DataFrame:
    """``p, q, rank`` (p <= q) of an interval module on 1..length: bars [birth, death) alive from p to q.

    A bar is counted once at its corner (birth, death - 1) and then prefix sums run up p and down q: the cost is that of
    the corners and the grid of axis positions, not bars times pairs.
    """
    spark = bars.sparkSession
    line = spark.range(1, length + 1)
    grid = line.select(F.col("id").cast("int").alias("p")).crossJoin(line.select(F.col("id").cast("int").alias("q")))  # an axis with itself
    corner = bars.groupBy(F.col("birth").cast("int").alias("p"), (F.col("death") - 1).cast("int").alias("q")).agg(F.sum("mult").alias("m"))
    dense = grid.join(corner, ["p", "q"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    up = Window.partitionBy("q").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("p").orderBy(F.col("q").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return dense.withColumn("m", F.sum("m").over(up)).withColumn("rank", F.sum("m").over(down)).filter("p <= q").select("p", "q", "rank")


def rectangles_of_rank(rank: DataFrame) -> DataFrame:
    """``lo, hi, w``: Moebius inversion of a rank table on a line: differences down p and up q. Zeros are dropped."""
    by_q, by_p = Window.partitionBy("q").orderBy("p"), Window.partitionBy("p").orderBy("q")
    once = rank.withColumn("r", F.col("rank") - F.coalesce(F.lag("rank").over(by_q), F.lit(0)))
    w = F.col("r") - F.coalesce(F.lead("r").over(by_p), F.lit(0))
    return once.select(F.col("p").alias("lo"), F.col("q").alias("hi"), w.alias("w")).filter("w <> 0")


def locate(values: DataFrame, axis: DataFrame, value: str = "value") -> DataFrame:
    """``values`` with ``pos``: the last axis position at or below the value, 0 below the first (an as-of join).

    Values and axis are merged and swept; groups are blocks of the value range, so no group holds everything, and each
    block starts from the last axis position before it.
    """
    span = axis.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    n = max(1, int(span["n"] or 1))
    width = max((float(span["hi"] or 0) - float(span["lo"] or 0)) / min(n, 4096), 1e-300)
    lo = float(span["lo"] or 0)
    block = lambda c: F.greatest(F.lit(-1), F.least(F.lit(4097), F.floor((F.col(c) - F.lit(lo)) / F.lit(width)))).cast("int")
    marks = axis.select(F.col("value").alias("v"), F.col("pos").alias("mark"))
    starts = marks.groupBy(block("v").alias("b")).agg(F.max("mark").alias("top"))
    before = F.coalesce(F.max("top").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = marks.sparkSession.range(-1, 4098).select(F.col("id").cast("int").alias("b")).join(starts, "b", "left").select("b", before.alias("base"))  # 4,099 rows
    left = values.withColumn("b", block(value)).withColumn("v", F.col(value)).withColumn("mark", F.lit(None).cast("int")).withColumn("own", F.lit(1))
    right = marks.select(*(F.lit(None).cast(values.schema[c].dataType).alias(c) for c in values.columns), block("v").alias("b"), "v", F.col("mark").cast("int").alias("mark"), F.lit(0).alias("own"))
    sweep = Window.partitionBy("b").orderBy("v", "own").rowsBetween(Window.unboundedPreceding, 0)
    swept = left.unionByName(right).withColumn("last", F.max("mark").over(sweep)).filter("own = 1").join(F.broadcast(blocks), "b")
    return swept.select(*values.columns, F.greatest(F.coalesce("last", F.lit(0)), F.col("base")).cast("int").alias("pos"))
