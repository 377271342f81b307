"""Closeness and betweenness from breadth-first searches of all sources at once.

A round extends every source's front by one hop: a join of fronts with arcs and a sum by (source, vertex). Tables hold a
row for each pair that a path joins, which is what these values are made of; nothing is held by one task or the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import cut
from .graphs import both_ways


def searches(vertices: DataFrame, edges: DataFrame) -> list[DataFrame]:
    """For each hop count a table ``s, v, n``: the vertices that far from s, with the number of shortest paths."""
    arcs = cut(both_ways(edges.filter("u <> v")).select("u", "v").distinct())
    levels = [cut(vertices.select(F.col("pid").alias("s"), F.col("pid").alias("v"), F.lit(1.0).alias("n")))]
    seen = levels[0].select("s", "v")
    while True:
        step = levels[-1].select("s", F.col("v").alias("u"), "n").join(arcs, "u").groupBy("s", "v").agg(F.sum("n").alias("n"))
        front = cut(step.join(seen, ["s", "v"], "left_anti"))
        if front.isEmpty():
            return levels
        levels.append(front)
        seen = cut(seen.unionByName(front.select("s", "v")))


def closeness(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``pid, value``: reachable others over the sum of their distances; 0 if isolated."""
    sums = vertices.select("pid", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("d"))
    for d, level in enumerate(searches(vertices, edges)[1:], 1):
        one = level.groupBy(F.col("s").alias("pid")).agg(F.count(F.lit(1)).alias("k"))
        sums = sums.unionByName(one.select("pid", "k", (F.col("k") * d).alias("d")))
    total = sums.groupBy("pid").agg(F.sum("k").alias("k"), F.sum("d").alias("d"))
    return total.select("pid", F.when(F.col("d") > 0, F.col("k") / F.col("d")).otherwise(0.0).alias("value"))


def betweenness(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``pid, value``: shortest paths through a vertex, summed over sources and halved; not normalised."""
    arcs = cut(both_ways(edges.filter("u <> v")).select("u", "v").distinct())
    levels = searches(vertices, edges)
    total = vertices.select("pid", F.lit(0.0).alias("part"))
    below = levels[-1].withColumn("share", F.lit(0.0))
    for level in reversed(levels[1:-1]):  # a vertex gets of each next one its share of the paths there
        up = below.withColumnRenamed("v", "w").withColumnRenamed("n", "m").join(arcs.select(F.col("u").alias("w"), "v"), "w")
        got = up.join(level, ["s", "v"]).groupBy("s", "v").agg(F.sum(F.col("n") / F.col("m") * (1 + F.col("share"))).alias("share"))
        below = cut(level.join(got, ["s", "v"], "left").select("s", "v", "n", F.coalesce("share", F.lit(0.0)).alias("share")))
        total = total.unionByName(below.groupBy(F.col("v").alias("pid")).agg(F.sum("share").alias("part")))
    return total.groupBy("pid").agg((F.sum("part") / 2).alias("value"))
