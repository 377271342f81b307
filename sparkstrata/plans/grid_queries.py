"""Queries on surfaces, signed measures and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import complexes, grids
from ..streaming import euler
from .registry import query
from .tables import BARS, MEASURE, bars, cells, read

SURFACE = f"{MEASURE}, a AS (SELECT DISTINCT i FROM m), b AS (SELECT DISTINCT j FROM m), s AS (SELECT a.i, b.j, CAST(coalesce((SELECT sum(w) FROM m WHERE m.i <= a.i AND m.j <= b.j), 0) AS BIGINT) AS value FROM a, b)"


def _measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.euler_measure(cells(spark, sf_dir))


@query("trade_euler_measure", f"WITH {MEASURE} SELECT i, j, w FROM m")
def trade_euler_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measure(spark, sf_dir)


@query("euler_surface", f"WITH {SURFACE} SELECT i, j, value FROM s")
def euler_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.surface(_measure(spark, sf_dir)).select("i", "j", F.col("value").cast("long").alias("value"))


@query("surface_roundtrip", f"WITH {MEASURE} SELECT i, j, w FROM m")
def surface_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moebius inversion of the surface gives the measure back."""
    return grids.mobius(grids.surface(_measure(spark, sf_dir))).select("i", "j", F.col("w").cast("long").alias("w"))


@query("measure_topk", f"WITH {MEASURE} SELECT i, j, w FROM m ORDER BY abs(w) DESC, i, j LIMIT 20")
def measure_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.truncated(_measure(spark, sf_dir), 20)


def _lifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measure moved one step along both axes."""
    return _measure(spark, sf_dir).select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), "w")


for _kind, _k in {"gaussian": "exp(-((a.i-b.i)*(a.i-b.i) + (a.j-b.j)*(a.j-b.j)) / 8e0)", "laplacian": "exp(-sqrt((a.i-b.i)*(a.i-b.i) + (a.j-b.j)*(a.j-b.j)) / 2e0)"}.items():
    query(f"measure_kernel_{_kind}", f"WITH {MEASURE} SELECT round(sum(a.w * b.w * {_k}) / 1e3, 3) AS kernel FROM m a, (SELECT i + 1 AS i, j + 1 AS j, w FROM m) b")(
        lambda spark, sf_dir, kind=_kind: grids.measure_kernel(_measure(spark, sf_dir), _lifted(spark, sf_dir), 2.0, kind).select(F.round(F.col("kernel") / 1e3, 3).alias("kernel"))
    )


def _two_surfaces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = grids.surface(_measure(spark, sf_dir))
    return s, s.select((F.col("i") + 1).alias("i"), "j", "value")


for _name, _order, _agg in (("l1", 1.0, "sum(g)"), ("l2", 2.0, "sqrt(sum(g * g))"), ("linf", float("inf"), "max(g)")):
    query(f"euler_distance_{_name}", f"WITH {SURFACE}, d AS (SELECT CAST(abs(coalesce(p.value, 0) - coalesce(q.value, 0)) AS DOUBLE) AS g FROM s p FULL JOIN (SELECT i + 1 AS i, j, value FROM s) q ON p.i = q.i AND p.j = q.j) SELECT round({_agg}, 3) AS distance FROM d")(
        lambda spark, sf_dir, order=_order: grids.distance(*_two_surfaces(spark, sf_dir), order).select(F.round("distance", 3).alias("distance"))
    )


@query("grid_locate", "WITH ax AS (SELECT v, row_number() OVER (ORDER BY v) AS pos FROM (SELECT DISTINCT CAST(p_size AS DOUBLE) * 1000 AS v FROM part)) SELECT o_orderkey, CAST(coalesce((SELECT max(pos) FROM ax WHERE v <= o_totalprice / 10), 0) AS INTEGER) AS pos FROM orders")
def grid_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders located on an axis of part sizes in thousands, a tenth of the price as coordinate."""
    sizes = read(spark, sf_dir, "part").select((F.col("p_size").cast("double") * 1000).alias("g"))
    axis = complexes.axes(sizes, "g").select("pos", "value")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 10).alias("value"))
    return grids.locate(orders, axis).select("o_orderkey", "pos")


LENGTH = 62
RANKS = f"{BARS}, r AS (SELECT p.i AS p, q.i AS q, CAST(coalesce((SELECT sum(mult) FROM bars WHERE birth <= p.i AND death > q.i), 0) AS BIGINT) AS rank FROM range(1, {LENGTH + 1}) p(i), range(1, {LENGTH + 1}) q(i) WHERE p.i <= q.i)"


def _rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.rank_of_bars(bars(spark, sf_dir), LENGTH)


@query("rank_invariant", f"WITH {RANKS} SELECT CAST(p AS INTEGER) AS p, CAST(q AS INTEGER) AS q, rank FROM r WHERE rank > 0")
def rank_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank(spark, sf_dir).filter("rank > 0")


@query("rank_diagonal", f"WITH {RANKS} SELECT CAST(p AS INTEGER) AS p, rank AS dim FROM r WHERE p = q")
def rank_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restricted Hilbert function: rank(a, a)."""
    return _rank(spark, sf_dir).filter("p = q").select("p", F.col("rank").alias("dim"))


@query("rect_barcode", f"WITH {BARS} SELECT CAST(birth AS INTEGER) AS lo, CAST(death - 1 AS INTEGER) AS hi, CAST(sum(mult) AS BIGINT) AS w FROM bars GROUP BY ALL")
def rect_barcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moebius inversion of the rank of an interval module gives its bars."""
    return grids.rectangles_of_rank(_rank(spark, sf_dir)).select("lo", "hi", F.col("w").cast("long").alias("w"))


@query("rank_from_rectangles", f"WITH {RANKS} SELECT CAST(p AS INTEGER) AS p, CAST(q AS INTEGER) AS q, rank FROM r WHERE rank > 0")
def rank_from_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rect = grids.rectangles_of_rank(_rank(spark, sf_dir)).select(F.col("lo").alias("birth"), (F.col("hi") + 1).alias("death"), F.col("w").alias("mult"))
    return grids.rank_of_bars(rect, LENGTH).filter("rank > 0")


@query("rectangle_topk", f"WITH {BARS} SELECT CAST(birth AS INTEGER) AS i, CAST(death - 1 AS INTEGER) AS j, CAST(sum(mult) AS BIGINT) AS w FROM bars GROUP BY ALL ORDER BY abs(sum(mult)) DESC, 1, 2 LIMIT 15")
def rectangle_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rect = grids.rectangles_of_rank(_rank(spark, sf_dir)).select(F.col("lo").alias("i"), F.col("hi").alias("j"), F.col("w").cast("long").alias("w"))
    return grids.truncated(rect, 15)


@query("rectangle_kernel_linear", f"WITH {BARS}, r AS (SELECT birth, death, sum(mult) AS w FROM bars GROUP BY ALL) SELECT CAST(sum(w * w) AS BIGINT) AS kernel FROM r")
def rectangle_kernel_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = grids.rectangles_of_rank(_rank(spark, sf_dir))
    return r.alias("a").join(r.alias("b"), ["lo", "hi"]).agg(F.sum(F.col("a.w") * F.col("b.w")).cast("long").alias("kernel"))


@query("event_window_euler", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, CAST(floor(value / 5e0) AS BIGINT) AS i, CAST(length(event_type) AS BIGINT) AS j, CAST(sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) AS BIGINT) AS w FROM events GROUP BY ALL")
def event_window_euler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return euler.windowed_measure(euler.event_cells(read(spark, sf_dir, "events"), 5.0))
