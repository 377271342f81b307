"""Connected components of an edge table by alternating large and small stars.

Every step is one grouped minimum (summed on the map side, so a hub's edges are never gathered) and one join of edges
with these minima. The minima are written first, so both sides of the join are shuffled and AQE can split a hub's. Each round is written to the shared folder, which cuts
lineage; nothing but a count and a checksum reaches the driver. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MAX_ROUNDS = 60


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(edges: DataFrame, rows: int) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = written(least, "least", rows)
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct()


def _small(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("m")), "least", rows)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """``node, root`` for every node of an edge but the roots themselves; a root is its component's least node.

    Self loops and repeated edges may occur. No edges give an empty result. ``rows``: about so many edges at most, if known.
    """
    now = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", rows)

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    seen = mark(now)
    for _ in range(MAX_ROUNDS if seen[0] else 0):
        rows = 2 * seen[0]  # of each table that a round writes, at most
        now = written(_small(_large(now, rows), rows), "edges", rows)
        then = mark(now)
        if then == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = then
    if seen[0]:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
