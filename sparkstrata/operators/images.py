"""Distances to a mask on a pixel grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distance_transform(pixels: DataFrame, height: int) -> DataFrame:
    """``i, j, value``: Euclidean distance of each pixel to the nearest pixel with ``mask``; null without any.

    Separable: a sweep along every row gives the distance within the row (window functions), then each pixel takes the
    least over the rows of its column, a join of a column with itself: ``height`` rows for each of its pixels.
    """
    up = F.last(F.when(F.col("mask"), F.col("j")), ignorenulls=True).over(Window.partitionBy("i").orderBy("j").rowsBetween(Window.unboundedPreceding, 0))
    down = F.first(F.when(F.col("mask"), F.col("j")), ignorenulls=True).over(Window.partitionBy("i").orderBy("j").rowsBetween(0, Window.unboundedFollowing))
    rows = pixels.select("i", "j", F.least(F.col("j") - up, down - F.col("j")).alias("g"))
    seen = rows.filter("g is not null").select(F.col("i").alias("i2"), "j", "g").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long"))))
    gap = F.col("i") - F.col("i2")
    best = seen.groupBy("i", "j").agg(F.sqrt(F.min((gap * gap + F.col("g") * F.col("g")).cast("double"))).alias("value"))
    return pixels.select("i", "j").join(best, ["i", "j"], "left")
