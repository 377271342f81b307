"""Queries on barcodes: summaries, landscapes, images, distances, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import direction_weight, kernel
from ..operators import bars as B
from .registry import query
from .tables import BARS, bars, read

GRID = [2.0 * k for k in range(33)]
TS = "ts AS (SELECT CAST(2 * k AS DOUBLE) AS t FROM range(33) r(k))"
KMAX = 3
TENT = "least(t - birth, death - t)"
LAND = f"{BARS}, {TS}, heights AS (SELECT slice, t, {TENT} AS h, sum(mult) AS m FROM bars JOIN ts ON t > birth AND t < death GROUP BY ALL), o AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY slice, t ORDER BY h DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM heights), land AS (SELECT slice, CAST(k AS INTEGER) AS k, t, CAST(h AS DOUBLE) AS value FROM o JOIN (SELECT k + 1 AS k FROM range({KMAX}) x(k)) ks ON k > b AND k <= b + m)"


@query("bars", f"WITH {BARS} SELECT * FROM bars")
def all_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir)


@query("bar_summary", f"WITH {BARS} SELECT slice, CAST(sum(mult) AS BIGINT) AS n_bars, CAST(sum((death - birth) * mult) AS DOUBLE) AS total, CAST(max(death - birth) AS DOUBLE) AS longest, round(sum((death - birth) * mult) / CAST(sum(mult) AS DOUBLE), 6) AS mean, round(sqrt(sum((death - birth) * (death - birth) * mult)), 6) AS l2 FROM bars GROUP BY slice")
def bar_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.summary(bars(spark, sf_dir)).withColumns({"mean": F.round("mean", 6), "l2": F.round("l2", 6)})


@query("bar_entropy", f"WITH {BARS}, x AS (SELECT slice, CAST(death - birth AS DOUBLE) AS l, mult, sum((death - birth) * mult) OVER (PARTITION BY slice) AS s, sum(mult) OVER (PARTITION BY slice) AS n FROM bars) SELECT slice, round(-sum(mult * (l / s) * ln(l / s)) / ln(max(n)), 5) AS entropy FROM x GROUP BY slice")
def bar_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.entropy(bars(spark, sf_dir)).withColumn("entropy", F.round("entropy", 5))


@query("landscape", f"WITH {LAND} SELECT slice, k, t, value FROM land")
def landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.landscape(bars(spark, sf_dir), GRID, KMAX)


@query("landscape_mean", f"WITH {LAND} SELECT k, t, round(sum(value) / (SELECT count(DISTINCT slice) FROM bars), 5) AS value FROM land GROUP BY k, t")
def landscape_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landscape feature aggregated over slices by the mean."""
    table = bars(spark, sf_dir)
    n = table.agg(F.countDistinct("slice").alias("n"))
    rows = B.landscape(table, GRID, KMAX).groupBy("k", "t").agg(F.sum("value").alias("s")).crossJoin(F.broadcast(n))  # one row
    return rows.select("k", "t", F.round(F.col("s") / F.col("n"), 5).alias("value"))


@query("silhouette", f"WITH {BARS}, {TS}, a AS (SELECT slice, sum((death - birth) * mult) AS w FROM bars GROUP BY slice) SELECT slice, t, round(sum((death - birth) * mult * {TENT}) / max(w), 5) AS value FROM bars JOIN ts ON t > birth AND t < death JOIN a USING (slice) GROUP BY slice, t")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.silhouette(bars(spark, sf_dir), GRID).withColumn("value", F.round("value", 5))


@query("betti_curve", f"WITH {BARS}, {TS} SELECT slice, t, CAST(sum(mult) AS BIGINT) AS n FROM bars JOIN ts ON t >= birth AND t < death GROUP BY slice, t")
def betti_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.betti_curve(bars(spark, sf_dir), GRID)


XS, YS = [10.0 * k for k in range(6)], [2.0 * k for k in range(7)]


@query("persistence_image", f"WITH {BARS}, gx AS (SELECT CAST(10 * k AS DOUBLE) AS x FROM range(6) a(k)), gy AS (SELECT CAST(2 * k AS DOUBLE) AS y FROM range(7) b(k)) SELECT slice, x, y, round(sum((death - birth) * mult * exp(-((x - birth) * (x - birth) + (y - (death - birth)) * (y - (death - birth))) / 32e0)), 4) AS value FROM bars, gx, gy GROUP BY slice, x, y")
def persistence_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.image(bars(spark, sf_dir), XS, YS, 4.0).withColumn("value", F.round("value", 4))


@query("bar_topk", f"WITH {BARS}, o AS (SELECT *, death - birth AS life, coalesce(sum(mult) OVER (PARTITION BY slice ORDER BY death - birth DESC, birth, death ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM bars) SELECT slice, CAST(k AS INTEGER) AS rank, birth, life AS persistence FROM o JOIN (SELECT k + 1 AS k FROM range(4) x(k)) ks ON k > b AND k <= b + mult")
def bar_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.top_k(bars(spark, sf_dir), 4)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Returned line items' bars and the others', by supplier."""
    item = read(spark, sf_dir, "lineitem")
    b = F.col("l_quantity").cast("long")
    table = item.groupBy(F.col("l_suppkey").alias("slice"), b.alias("birth"), (b + 1 + F.rint(F.col("l_discount") * 100).cast("long")).alias("death"), (F.col("l_returnflag") == "R").alias("back")).agg(F.count(F.lit(1)).alias("mult"))
    return table.filter("back").drop("back"), table.filter("not back").drop("back")


HALVES = (
    f"hb AS (SELECT l_returnflag = 'R' AS back, l_suppkey AS slice, CAST(l_quantity AS BIGINT) AS birth, CAST(l_quantity AS BIGINT) + 1 + CAST(round_even(l_discount*100, 0) AS BIGINT) AS death, count(*) AS mult FROM lineitem GROUP BY ALL), {TS}, "
    f"heights AS (SELECT back, slice, t, {TENT} AS h, sum(mult) AS m FROM hb JOIN ts ON t > birth AND t < death GROUP BY ALL), o AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY back, slice, t ORDER BY h DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM heights), "
    f"land AS (SELECT back, slice, k, t, CAST(h AS DOUBLE) AS value FROM o JOIN (SELECT k + 1 AS k FROM range({KMAX}) x(k)) ks ON k > b AND k <= b + m), x AS (SELECT * FROM land WHERE back), y AS (SELECT * FROM land WHERE NOT back)"
)


@query("landscape_distance", f"WITH {HALVES} SELECT round(sqrt(sum(power(coalesce(x.value, 0) - coalesce(y.value, 0), 2)) * 2), 4) AS distance FROM x FULL JOIN y ON x.slice = y.slice AND x.k = y.k AND x.t = y.t")
def landscape_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (B.landscape(h, GRID, KMAX) for h in _halves(spark, sf_dir))
    return B.landscape_distance(a, b, 2.0).select(F.round("distance", 4).alias("distance"))


@query("landscape_inner_product", f"WITH {HALVES} SELECT round(sum(x.value * y.value) * 2, 2) AS inner_product FROM x JOIN y ON x.slice = y.slice AND x.k = y.k AND x.t = y.t")
def landscape_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (B.landscape(h, GRID, KMAX) for h in _halves(spark, sf_dir))
    return B.landscape_inner(a, b, 2.0).select(F.round("inner_product", 2).alias("inner_product"))


@query("landscape_kernel", f"WITH {HALVES} SELECT round(exp(-sum(power(coalesce(x.value, 0) - coalesce(y.value, 0), 2)) * 2 / (2 * 400e0 * 400e0)), 6) AS kernel FROM x FULL JOIN y ON x.slice = y.slice AND x.k = y.k AND x.t = y.t")
def landscape_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (B.landscape(h, GRID, KMAX) for h in _halves(spark, sf_dir))
    return B.landscape_distance(a, b, 2.0).select(F.round(kernel(F.col("distance"), "gaussian", 400.0), 6).alias("kernel"))


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slice_weights(spark, sf_dir).withColumn("weight", F.round("weight", 6))


def slice_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("slice")).distinct().select("slice", direction_weight(F.col("slice") + 1.0, F.lit(5.0)).alias("weight"))


@query("slice_bottleneck")
def slice_bottleneck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.slice_distances(*_halves(spark, sf_dir), "bottleneck").withColumn("distance", F.round("distance", 6))


@query("slice_wasserstein")
def slice_wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.slice_distances(*_halves(spark, sf_dir), "wasserstein").withColumn("distance", F.round("distance", 6))


@query("matching_distance")
def matching_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.matching_distance(*_halves(spark, sf_dir), _weights(spark, sf_dir)).select(F.round("distance", 6).alias("distance"))


@query("sliced_wasserstein")
def sliced_wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.sliced_distance(*_halves(spark, sf_dir), _weights(spark, sf_dir)).select(F.round("distance", 6).alias("distance"))


@query("direction_weights", "WITH d AS (SELECT a.k AS a, b.k AS b FROM range(1, 9) a(k), range(1, 9) b(k) WHERE gcd(a.k, b.k) = 1) SELECT a, b, round(least(a, b) / CAST(a + b AS DOUBLE), 6) AS l1, round(least(a, b) / CAST(greatest(a, b) AS DOUBLE), 6) AS linf FROM d")
def direction_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coprime directions up to denominator 8 with both weights; pairs share no divisor of 2, 3, 5 or 7."""
    k = spark.range(1, 9)
    both = k.select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("b"))
    for p in (2, 3, 5, 7):
        both = both.filter((F.col("a") % p != 0) | (F.col("b") % p != 0))
    return both.select("a", "b", F.round(direction_weight(F.col("a"), F.col("b")), 6).alias("l1"), F.round(direction_weight(F.col("a"), F.col("b"), "lesnick_linf"), 6).alias("linf"))


FEATURES = f"{BARS}, f AS (SELECT slice, CAST(sum(mult) AS DOUBLE) AS count, CAST(sum((death - birth) * mult) AS DOUBLE) AS total, CAST(max(death - birth) AS DOUBLE) AS longest FROM bars GROUP BY slice)"


@query("feature_wide", f"WITH {FEATURES} SELECT slice AS id, count, total, longest FROM f")
def feature_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.summary(bars(spark, sf_dir))
    return s.select(F.col("slice").alias("id"), F.col("n_bars").cast("double").alias("count"), "total", "longest")


@query("feature_long", f"WITH {FEATURES} SELECT slice AS id, 'count' AS feature, count AS value FROM f UNION ALL SELECT slice, 'total', total FROM f UNION ALL SELECT slice, 'longest', longest FROM f")
def feature_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_wide(spark, sf_dir).unpivot("id", ["count", "total", "longest"], "feature", "value")
