"""Encodings of presented modules: boxes, flanges and fringes become signature regions on a finite grid.

A box generator is an interval for each axis; a point's signature is the set of upsets and downsets that hold it.
Regions are the distinct signatures. Memberships are tables, the order of regions is containment of upset signatures
and is written as a predicate. Fibre dimensions are ranks of small submatrices, one grouped kernel for each region.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import rank
from ..functions.store import numbered

SENT = 100_000
BLOCKS = 64


def breakpoints(boxes: DataFrame, axis: str) -> DataFrame:
    """``pos, value``: sorted distinct bounds of one axis (``lo_<axis>`` of upsets, ``hi_<axis>`` of downsets)."""
    both = boxes.select(F.col(f"lo_{axis}").alias("value")).unionByName(boxes.select(F.col(f"hi_{axis}").alias("value"))).filter("value is not null").distinct()
    return numbered(both, "value").select(F.col("pos").cast("int").alias("pos"), "value")


def cells(boxes: DataFrame) -> DataFrame:
    """``x, y``: the grid of representatives, the lower corners of the arrangement's cells."""
    return breakpoints(boxes, "x").select(F.col("value").alias("x")).crossJoin(breakpoints(boxes, "y").select(F.col("value").alias("y")))


def signatures(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """``x, y, ups, downs``: ids of the upsets (lo <= point) and downsets (point <= hi) that hold each point.

    Null bounds are free directions. Up to ``SENT`` generators are sent to all tasks; more are spread over blocks of x,
    cut at quantiles of the points, and meet only the points of the blocks they reach.
    """
    inside = (F.col("lo_x").isNull() | (F.col("lo_x") <= F.col("x"))) & (F.col("lo_y").isNull() | (F.col("lo_y") <= F.col("y")))
    below = (F.col("hi_x").isNull() | (F.col("x") <= F.col("hi_x"))) & (F.col("hi_y").isNull() | (F.col("y") <= F.col("hi_y")))
    up, down = boxes.filter("kind = 'up'"), boxes.filter("kind = 'down'")
    if boxes.count() <= SENT:
        held = points.join(F.broadcast(up), inside).select("x", "y", F.col("gen").alias("up"), F.lit(None).cast("int").alias("down"))
        held = held.unionByName(points.join(F.broadcast(down), below).select("x", "y", F.lit(None).cast("int").alias("up"), F.col("gen").alias("down")))
    else:
        cuts = sorted(set(points.approxQuantile("x", [k / BLOCKS for k in range(1, BLOCKS)], 0.01)))
        block = lambda c: F.size(F.filter(F.array(*(F.lit(float(v)) for v in cuts)), lambda v: v <= c.cast("double")))
        at = points.withColumn("_b", block(F.col("x")))
        rising = up.withColumn("_b", F.explode(F.sequence(F.when(F.col("lo_x").isNull(), F.lit(0)).otherwise(block(F.col("lo_x"))), F.lit(len(cuts)))))
        falling = down.withColumn("_b", F.explode(F.sequence(F.lit(0), F.when(F.col("hi_x").isNull(), F.lit(len(cuts))).otherwise(block(F.col("hi_x"))))))
        held = at.join(rising, "_b").filter(inside).select("x", "y", F.col("gen").alias("up"), F.lit(None).cast("int").alias("down"))
        held = held.unionByName(at.join(falling, "_b").filter(below).select("x", "y", F.lit(None).cast("int").alias("up"), F.col("gen").alias("down")))
    every = points.select("x", "y", F.lit(None).cast("int").alias("up"), F.lit(None).cast("int").alias("down"))
    return held.unionByName(every).groupBy("x", "y").agg(F.array_sort(F.collect_set("up")).alias("ups"), F.array_sort(F.collect_set("down")).alias("downs"))


def regions(signed: DataFrame) -> DataFrame:
    """``ups, downs, n_points, x0, y0, x1, y1``: one row for each signature, with its bounding box."""
    return signed.groupBy("ups", "downs").agg(F.count(F.lit(1)).alias("n_points"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def region_order(found: DataFrame) -> DataFrame:
    """``a, b``: pairs of regions (as upset lists) with a's upsets within b's and b's downsets within a's.

    Regions are joined on one shared upset (or are the ones without any), not all by all.
    """
    left = found.select(F.col("ups").alias("a"), F.col("downs").alias("da"))
    right = found.select(F.col("ups").alias("b"), F.col("downs").alias("db"))
    keyed = left.withColumn("k", F.coalesce(F.try_element_at("a", F.lit(1)).cast("string"), F.lit("-")))
    spread = right.withColumn("k", F.explode(F.array_union(F.transform("b", lambda g: g.cast("string")), F.array(F.lit("-")))))
    fits = (F.size(F.array_except("a", "b")) == 0) & (F.size(F.array_except("db", "da")) == 0)
    return keyed.join(spread, "k").filter(fits).select("a", "da", "b", "db")


def fiber_dimensions(found: DataFrame, phi: DataFrame, field: int | str | None = None) -> DataFrame:
    """``ups, downs, dim``: rank of phi (``down, up, num, den``) on each region's downsets and upsets."""
    at = found.select("ups", "downs")
    entries = at.withColumn("up", F.explode("ups")).join(phi.filter("num <> 0"), "up").filter(F.array_contains("downs", F.col("down")))
    held = entries.groupBy("ups", "downs").agg(F.collect_list(F.struct("down", "up", "num", "den")).alias("phi"))

    def run(it):
        for pdf in it:
            dims = []
            for ups, downs, phi in zip(pdf["ups"], pdf["downs"], pdf["phi"], strict=True):
                value = {(e["down"], e["up"]): Fraction(int(e["num"]), int(e["den"])) for e in phi}
                dims.append(rank([[value.get((d, u), 0) for u in ups] for d in downs], field))
            yield pd.DataFrame({"ups": pdf["ups"], "downs": pdf["downs"], "dim": dims})

    ranked = held.mapInPandas(run, "ups array<int>, downs array<int>, dim int")
    return at.join(ranked, ["ups", "downs"], "left").select("ups", "downs", F.coalesce("dim", F.lit(0)).alias("dim"))


def upset_closure(generators: DataFrame, order: DataFrame) -> DataFrame:
    """``gen, q``: everything at or above a generator. ``order``: reflexive pairs a <= b."""
    return generators.join(order, F.col("q") == F.col("a")).select("gen", F.col("b").alias("q")).distinct()


def downset_closure(generators: DataFrame, order: DataFrame) -> DataFrame:
    return generators.join(order, F.col("q") == F.col("b")).select("gen", F.col("a").alias("q")).distinct()


def cover_edges(order: DataFrame) -> DataFrame:
    """``a, b``: pairs a < b with nothing strictly between."""
    strict = order.filter("a <> b").select("a", "b")
    two = strict.select("a", F.col("b").alias("m")).join(strict.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
    return strict.join(two, ["a", "b"], "left_anti")


def grid_order(n: int, m: int, spark) -> DataFrame:
    """``a, b``: order of the product of chains 0..n-1 and 0..m-1, points numbered i * m + j. For small posets."""
    p = spark.range(n * m).select(F.col("id").alias("a"), F.floor(F.col("id") / m).alias("ai"), (F.col("id") % m).alias("aj"))
    above = p.withColumn("bi", F.explode(F.sequence(F.col("ai"), F.lit(n - 1).cast("long")))).withColumn("bj", F.explode(F.sequence(F.col("aj"), F.lit(m - 1).cast("long"))))
    return above.select("a", (F.col("bi") * m + F.col("bj")).alias("b"))


def uptight_regions(membership: DataFrame) -> DataFrame:
    """``signature, n, least``: classes of points (``gen, q``) by the generators that hold them."""
    sig = membership.groupBy("q").agg(F.array_sort(F.collect_set("gen")).alias("signature"))
    return sig.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.min("q").alias("least"))
