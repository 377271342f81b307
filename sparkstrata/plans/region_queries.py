"""Queries on regions, presentations and small modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import presentations as S
from ..operators import regions as R
from .registry import query
from .tables import ADJACENCY, BOXES, LABELS, REGIONS, boxes, labels, read, regions


@query("dim_stats", f"WITH {REGIONS} SELECT sum(weight) AS total_measure, sum(weight * dim) AS integrated_mass, round(sum(weight * dim) / sum(weight), 6) AS mean_dim, round(sum(weight * dim * dim) / sum(weight) - power(sum(weight * dim) / sum(weight), 2), 6) AS var_dim FROM reg")
def dim_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dim_stats(regions(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean_dim", "var_dim")})


@query("dim_norm_l2", f"WITH {REGIONS} SELECT round(sqrt(sum(weight * dim * dim)), 6) AS norm FROM reg")
def dim_norm_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dim_norm(regions(spark, sf_dir)).select(F.round("norm", 6).alias("norm"))


@query("dim_norm_linf", f"WITH {REGIONS} SELECT CAST(max(abs(dim)) AS DOUBLE) AS norm FROM reg")
def dim_norm_linf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dim_norm(regions(spark, sf_dir), float("inf"))


@query("measure_by_dimension", f"WITH {REGIONS} SELECT dim, sum(weight) AS measure FROM reg GROUP BY dim")
def measure_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_dimension(regions(spark, sf_dir))


@query("support_measure", f"WITH {REGIONS} SELECT coalesce(sum(CASE WHEN dim >= 2 THEN weight END), 0) AS measure FROM reg")
def support_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.support_measure(regions(spark, sf_dir), 2)


@query("support_bbox", f"WITH {REGIONS} SELECT min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM reg WHERE dim >= 1")
def support_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.support_bbox(regions(spark, sf_dir))


@query("support_diameter", f"WITH {REGIONS} SELECT round(sqrt(power(max(x1) - min(x0), 2) + power(max(y1) - min(y0), 2)), 6) AS diameter FROM reg WHERE dim >= 1")
def support_diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.support_diameter(regions(spark, sf_dir)).select(F.round("diameter", 6).alias("diameter"))


@query("region_entropy", f"WITH {REGIONS}, t AS (SELECT sum(weight) AS s FROM reg) SELECT round(-sum(weight / s * ln(weight / s)), 6) AS entropy FROM reg, t")
def region_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.weight_entropy(regions(spark, sf_dir)).select(F.round("entropy", 6).alias("entropy"))


ASPECT = "CASE WHEN x1 = x0 AND y1 = y0 THEN 1 ELSE greatest(x1 - x0, y1 - y0) / CAST(least(CASE WHEN x1 > x0 THEN x1 - x0 ELSE y1 - y0 END, CASE WHEN y1 > y0 THEN y1 - y0 ELSE x1 - x0 END) AS DOUBLE) END"


@query("aspect_stats", f"WITH {REGIONS}, a AS (SELECT weight, {ASPECT} AS aspect FROM reg) SELECT sum(weight) AS total_measure, round(sum(weight * aspect) / sum(weight), 6) AS mean_aspect, round(min(aspect), 6) AS min_aspect, round(max(aspect), 6) AS max_aspect FROM a")
def aspect_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.aspect_stats(regions(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean_aspect", "min_aspect", "max_aspect")})


@query("volume_histogram", f"WITH {REGIONS} SELECT dim, CAST(least(floor(weight / 10e0), 9) AS INTEGER) AS bin, count(*) AS n FROM reg WHERE weight BETWEEN 0 AND 100 GROUP BY ALL")
def volume_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram_by_dim(regions(spark, sf_dir), 10, 0.0, 100.0)


def _adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.grid_adjacency(labels(spark, sf_dir))


@query("region_adjacency", f"WITH {ADJACENCY} SELECT r, s, measure FROM adj")
def region_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjacency(spark, sf_dir)


@query("interface_measure", f"WITH {ADJACENCY} SELECT CAST(coalesce(sum(measure), 0) AS BIGINT) AS measure FROM adj")
def interface_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.interface_measure(_adjacency(spark, sf_dir))


@query("interface_by_dims", f"WITH {ADJACENCY} SELECT least(a.dim, b.dim) AS low, greatest(a.dim, b.dim) AS high, CAST(sum(measure) AS BIGINT) AS measure FROM adj JOIN reg a ON a.region = r JOIN reg b ON b.region = s GROUP BY ALL")
def interface_by_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.interface_by_dims(_adjacency(spark, sf_dir), regions(spark, sf_dir))


@query("interface_changes", f"WITH {ADJACENCY} SELECT CAST(coalesce(sum(measure), 0) AS BIGINT) AS measure FROM adj JOIN reg a ON a.region = r JOIN reg b ON b.region = s WHERE a.dim <> b.dim")
def interface_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.interface_changes(_adjacency(spark, sf_dir), regions(spark, sf_dir))


HILBERT = "a AS (SELECT p_size AS region, count(*) AS dim FROM part WHERE p_retailprice < 1400 GROUP BY 1), b AS (SELECT p_size AS region, count(*) AS dim FROM part WHERE p_retailprice >= 1400 GROUP BY 1), g AS (SELECT CAST(abs(coalesce(a.dim, 0) - coalesce(b.dim, 0)) AS DOUBLE) AS g FROM a FULL JOIN b ON a.region = b.region)"


for _norm, _agg in {"L1": "sum(g)", "L2": "sqrt(sum(g * g))", "Linf": "max(g)"}.items():

    def _hilbert(spark: SparkSession, sf_dir: str, norm: str = _norm) -> DataFrame:
        part = read(spark, sf_dir, "part")
        cut = lambda c: part.filter(c).groupBy(F.col("p_size").alias("region")).agg(F.count(F.lit(1)).alias("dim"))
        return R.hilbert_distance(cut("p_retailprice < 1400"), cut("p_retailprice >= 1400"), norm).select(F.round("distance", 6).alias("distance"))

    query("hilbert_distance" if _norm == "L1" else f"hilbert_distance_{_norm.lower()}", f"WITH {HILBERT} SELECT round({_agg}, 6) AS distance FROM g")(_hilbert)


def _text(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return S.signatures(S.cells(b), b)


@query("fringe_membership", f"WITH {BOXES} SELECT x, y, ups, downs FROM sig")
def fringe_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed(spark, sf_dir).select("x", "y", _text("ups").alias("ups"), _text("downs").alias("downs"))


@query("signature_regions", f"WITH {BOXES} SELECT ups, downs, count(*) AS n_points, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM sig GROUP BY ups, downs")
def signature_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.regions(_signed(spark, sf_dir)).select(_text("ups").alias("ups"), _text("downs").alias("downs"), "n_points", "x0", "y0", "x1", "y1")


@query("fiber_dimension", f"WITH {BOXES} SELECT ups, downs, CAST(len(list_intersect(string_split(ups, ','), string_split(downs, ','))) - CASE WHEN ups = '' AND downs = '' THEN 1 ELSE 0 END AS INTEGER) AS dim FROM (SELECT DISTINCT ups, downs FROM sig)")
def fiber_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the unit matrix the rank on a region is the number of generators in both lists."""
    phi = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("down"), F.col("n_nationkey").cast("int").alias("up"), F.lit(1).alias("num"), F.lit(1).alias("den"))
    return S.fiber_dimensions(S.regions(_signed(spark, sf_dir)), phi).select(_text("ups").alias("ups"), _text("downs").alias("downs"), "dim")


@query("region_order", f"WITH {BOXES}, g AS (SELECT DISTINCT ups, downs, CASE WHEN ups = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(ups, ',') END AS u, CASE WHEN downs = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(downs, ',') END AS d FROM sig) SELECT a.ups AS a, a.downs AS da, b.ups AS b, b.downs AS db FROM g a JOIN g b ON list_has_all(b.u, a.u) AND list_has_all(a.d, b.d)")
def region_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.region_order(S.regions(_signed(spark, sf_dir))).select(*(_text(c).alias(c) for c in ("a", "da", "b", "db")))


N, M = 6, 4
ORDER = f"pt AS (SELECT i * {M} + j AS q, i, j FROM range({N}) a(i), range({M}) b(j)), le AS (SELECT x.q AS a, y.q AS b FROM pt x JOIN pt y ON x.i <= y.i AND x.j <= y.j)"


@query("grid_order", f"WITH {ORDER} SELECT a, b FROM le")
def grid_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.grid_order(N, M, spark)


@query("cover_edges", f"WITH {ORDER} SELECT a, b FROM le WHERE a <> b AND NOT EXISTS (SELECT 1 FROM le p JOIN le q ON p.b = q.a WHERE p.a = le.a AND q.b = le.b AND p.b <> le.a AND p.b <> le.b)")
def cover_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cover_edges(S.grid_order(N, M, spark))


def _generators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("gen"), (F.col("n_nationkey") % (N * M)).cast("long").alias("q"))


GENS = f"{ORDER}, gen AS (SELECT CAST(n_nationkey AS BIGINT) AS gen, CAST(n_nationkey % {N * M} AS BIGINT) AS q FROM nation)"


@query("upset_closure", f"WITH {GENS} SELECT DISTINCT gen, le.b AS q FROM gen JOIN le ON le.a = gen.q")
def upset_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.upset_closure(_generators(spark, sf_dir), S.grid_order(N, M, spark))


@query("downset_closure", f"WITH {GENS} SELECT DISTINCT gen, le.a AS q FROM gen JOIN le ON le.b = gen.q")
def downset_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.downset_closure(_generators(spark, sf_dir), S.grid_order(N, M, spark))


@query("uptight_regions", f"WITH {GENS}, s AS (SELECT le.b AS q, string_agg(DISTINCT CAST(gen AS VARCHAR), ',' ORDER BY CAST(gen AS VARCHAR)) AS signature FROM gen JOIN le ON le.a = gen.q GROUP BY 1) SELECT signature, count(*) AS n, min(q) AS least FROM s GROUP BY signature")
def uptight_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of grid points by the upsets that hold them."""
    up = S.upset_closure(_generators(spark, sf_dir), S.grid_order(N, M, spark))
    sig = S.uptight_regions(up.select(F.col("gen").cast("string").alias("gen"), "q"))
    return sig.select(F.array_join("signature", ",").alias("signature"), "n", "least")


@query("region_labels", f"WITH {LABELS} SELECT region, count(*) AS n FROM lab GROUP BY region")
def region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).groupBy("region").agg(F.count(F.lit(1)).alias("n"))
