"""Queries on region geometry, supports and module sizes. Boxes are the regions' bounding boxes of unit squares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boxes as X
from ..operators import regions as R
from ..operators import supports as S
from .registry import query
from .tables import ADJACENCY, LABELS, REGIONS, labels, regions

BOX = f"{REGIONS}, box AS (SELECT region, x0, y0, x1 + 1 AS x2, y1 + 1 AS y2, CAST(x1 + 1 - x0 AS DOUBLE) AS w, CAST(y1 + 1 - y0 AS DOUBLE) AS h FROM reg)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).select("region", F.array("x0", "y0").alias("lo"), F.array(F.col("x1") + 1, F.col("y1") + 1).alias("hi"))


def _adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.grid_adjacency(labels(spark, sf_dir))


def _text(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ",")


@query("region_widths", f"WITH {BOX} SELECT region, w AS width_x, h AS width_y FROM box")
def region_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("region", F.get(X.widths(), F.lit(0)).alias("width_x"), F.get(X.widths(), F.lit(1)).alias("width_y"))


@query("region_centroid", f"WITH {BOX} SELECT region, (x0 + x2) / 2e0 AS x, (y0 + y2) / 2e0 AS y FROM box")
def region_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("region", F.get(X.centroid(), F.lit(0)).alias("x"), F.get(X.centroid(), F.lit(1)).alias("y"))


@query("region_facet_vertex_count", f"WITH {BOX} SELECT region, 4 AS facets, 4 AS vertices FROM box")
def region_facet_vertex_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("region", X.facet_count().alias("facets"), X.vertex_count().alias("vertices"))


@query("region_volume_boundary", f"WITH {BOX} SELECT region, w * h AS volume, 2 * (w + h) AS boundary, round(2 * (w + h) / (w * h), 9) AS ratio FROM box")
def region_volume_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir).select("region", X.volume().alias("volume"), X.boundary().alias("boundary"))
    return b.withColumn("ratio", F.round(X.boundary_to_volume(F.col("boundary"), F.col("volume")), 9))


@query("region_boundary_breakdown", f"WITH {BOX} SELECT region, axis, side, CASE axis WHEN 0 THEN h ELSE w END AS measure FROM box, (VALUES (0), (1)) a(axis), (VALUES (-1), (1)) s(side)")
def region_boundary_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.breakdown(_boxes(spark, sf_dir))


@query("region_radii", f"WITH {BOX} SELECT region, least(w, h) / 2 AS inner_radius, round(sqrt(w * w + h * h) / 2, 9) AS outer_l2, (w + h) / 2 AS outer_l1, greatest(w, h) / 2 AS outer_linf FROM box")
def region_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("region", X.chebyshev_radius().alias("inner_radius"), F.round(X.circumradius(), 9).alias("outer_l2"), X.circumradius("L1").alias("outer_l1"), X.circumradius("Linf").alias("outer_linf"))


@query("region_isoperimetric", f"WITH {BOX}, q AS (SELECT region, sqrt(pi() * w * h) / (w + h) AS q FROM box) SELECT region, round(q, 9) AS quotient, round(1 / q, 9) AS ratio, round(1 - q, 9) AS deficit, round(q * q, 9) AS planar FROM q")
def region_isoperimetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir).select("region", X.volume().alias("v"), X.boundary().alias("s"))
    return b.select("region", *(F.round(X.isoperimetric(F.col("s"), F.col("v"), 2, k), 9).alias(k) for k in ("quotient", "ratio", "deficit", "planar")))


@query("region_minkowski", f"WITH {BOX} SELECT region, w * h AS volume, 2 * (w + h) AS boundary_measure, round(2 * (w + h) / pi(), 9) AS mean_width FROM box")
def region_minkowski(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.minkowski_functionals(_boxes(spark, sf_dir), 2).withColumn("mean_width", F.round("mean_width", 9))


AXES = f"{LABELS}, c AS (SELECT region, avg(i + 0.5e0) AS mean_i, avg(j + 0.5e0) AS mean_j, var_pop(i) + 1 / 12e0 AS a, var_pop(j) + 1 / 12e0 AS b, covar_pop(i, j) AS c FROM lab GROUP BY region), ev AS (SELECT region, mean_i, mean_j, (a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c) AS lmax, (a + b) / 2 - sqrt((a - b) * (a - b) / 4 + c * c) AS lmin, a, b, c FROM c)"


@query("region_principal_directions", f"WITH {AXES} SELECT region, round(mean_i, 6) AS mean_i, round(mean_j, 6) AS mean_j, round(lmax, 6) AS lmax, round(lmin, 6) AS lmin, round(abs(sin(atan2(2 * c, a - b))), 5) AS tilt FROM ev WHERE lmax - lmin > 1e-6")
def region_principal_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tilt`` is |sin 2 angle|, which doesn't jump where the axis turns over."""
    d = X.principal_directions(labels(spark, sf_dir)).filter("lmax - lmin > 1e-6")
    return d.select("region", *(F.round(c, 6).alias(c) for c in ("mean_i", "mean_j", "lmax", "lmin")), F.round(F.abs(F.sin(2 * F.col("angle"))), 5).alias("tilt"))


@query("region_anisotropy", f"WITH {AXES} SELECT region, round(lmax / lmin, 6) AS ratio, round(ln(lmax / lmin), 6) AS log_ratio, round((lmax - lmin) / (lmax + lmin), 6) AS normalized, round(sqrt(greatest(1 - lmin / lmax, 0)), 3) AS eccentricity FROM ev")
def region_anisotropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.anisotropy_scores(X.principal_directions(labels(spark, sf_dir)))
    return s.select("region", *(F.round(c, 6).alias(c) for c in ("ratio", "log_ratio", "normalized")), F.round("eccentricity", 3).alias("eccentricity"))


OUTLINE = f"{REGIONS}, inner_ AS (SELECT a.region FROM lab a JOIN lab b ON a.region = b.region AND ((b.i = a.i + 1 AND b.j = a.j) OR (b.i = a.i AND b.j = a.j + 1))), outl AS (SELECT reg.region, reg.dim, reg.weight, 4 * reg.weight - 2 * (SELECT count(*) FROM inner_ WHERE inner_.region = reg.region) AS boundary FROM reg)"


@query("region_outline", f"WITH {OUTLINE} SELECT region, CAST(boundary AS DOUBLE) AS boundary FROM outl")
def region_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.outline(labels(spark, sf_dir))


def _ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions(spark, sf_dir).join(X.outline(labels(spark, sf_dir)), "region")
    return rows.withColumn("ratio", F.round(F.col("boundary") / F.col("weight"), 9))


@query("boundary_to_volume_samples", f"WITH {OUTLINE} SELECT dim, string_agg(CAST(CAST(round(boundary / weight * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY round(boundary / weight * 1000)) AS samples FROM outl GROUP BY dim")
def boundary_to_volume_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios in thousandths."""
    rows = _ratios(spark, sf_dir).withColumn("ratio", F.round(F.col("boundary") / F.col("weight") * 1000))
    return S.samples_by_dim(rows, "ratio").select("dim", _text("samples").alias("samples"))


@query("boundary_to_volume_histogram", f"WITH {OUTLINE} SELECT dim, CAST(least(floor(round(boundary / weight, 9) / 0.4e0), 9) AS INTEGER) AS bin, count(*) AS n FROM outl WHERE round(boundary / weight, 9) BETWEEN 0 AND 4 GROUP BY ALL")
def boundary_to_volume_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram_by_dim(_ratios(spark, sf_dir).select("dim", F.col("ratio").alias("weight")), 10, 0.0, 4.0)


@query("volume_samples", f"WITH {REGIONS} SELECT dim, string_agg(CAST(CAST(weight AS BIGINT) AS VARCHAR), ',' ORDER BY weight) AS samples FROM reg GROUP BY dim")
def volume_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.samples_by_dim(regions(spark, sf_dir)).select("dim", _text("samples").alias("samples"))


@query("support_mask", f"WITH {REGIONS} SELECT region, dim >= 2 AS inside FROM reg")
def support_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.mask(regions(spark, sf_dir), 2)


@query("support_vertices", f"WITH {REGIONS} SELECT region FROM reg WHERE dim >= 2")
def support_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.vertices(regions(spark, sf_dir), 2)


# Distances within the support: rows (a, b, d) grow by one hop a round, so the least d of a pair is its distance.
HOPS = (
    f"{ADJACENCY}, ins AS (SELECT region AS p FROM reg WHERE dim >= 2), arc AS (SELECT r AS u, s AS v FROM adj UNION ALL SELECT s, r FROM adj), live AS (SELECT u, v FROM arc WHERE u IN (SELECT p FROM ins) AND v IN (SELECT p FROM ins)), "
    "walk AS (SELECT p AS a, p AS b, 0 AS d FROM ins UNION SELECT walk.a, live.v, walk.d + 1 FROM walk JOIN live ON live.u = walk.b WHERE walk.d < (SELECT count(*) FROM ins)), dist AS (SELECT a, b, min(d) AS d FROM walk GROUP BY a, b)"
)


@query("support_components", f"WITH RECURSIVE {HOPS} SELECT a AS region, min(b) AS component FROM dist GROUP BY a")
def support_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.components(regions(spark, sf_dir), _adjacent(spark, sf_dir), 2)


@query("support_graph_diameter", f"WITH RECURSIVE {HOPS}, r AS (SELECT a, min(b) AS component, max(d) AS far FROM dist GROUP BY a) SELECT component, count(*) AS size, max(far) AS diameter FROM r GROUP BY component")
def support_graph_diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.graph_diameter(regions(spark, sf_dir), _adjacent(spark, sf_dir), 2)


@query("region_values", f"WITH {BOX} SELECT region, CAST(x0 + 10 * y0 AS BIGINT) AS value FROM box")
def region_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of each region's representative, its lower corner."""
    return regions(spark, sf_dir).select("region", (F.col("x0") + 10 * F.col("y0")).alias("value"))


@query("measure_by_value", f"WITH {BOX} SELECT CAST(x0 + 10 * y0 AS BIGINT) AS value, sum(weight) AS measure FROM box JOIN (SELECT region, weight FROM reg) USING (region) GROUP BY 1")
def measure_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.measure_by_value(region_values(spark, sf_dir), regions(spark, sf_dir))


@query("vertex_set_measure", f"WITH {REGIONS} SELECT coalesce(sum(weight), 0) AS measure FROM reg WHERE dim IN (1, 3)")
def vertex_set_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = regions(spark, sf_dir)
    return S.vertex_set_measure(table.filter(F.col("dim").isin(1, 3)), table)


@query("module_size_summary", f"WITH {REGIONS} SELECT sum(weight) AS total_measure, sum(weight * dim) AS integrated_mass, round(sum(weight * dim) / sum(weight), 6) AS mean_dim, round(sum(weight * dim * dim) / sum(weight) - power(sum(weight * dim) / sum(weight), 2), 6) AS var_dim, sum(CASE WHEN dim >= 1 THEN weight ELSE 0 END) AS support_measure, (SELECT string_agg(dim || ':' || CAST(w AS BIGINT), ',' ORDER BY dim) FROM (SELECT dim, sum(weight) AS w FROM reg GROUP BY dim)) AS by_dim FROM reg")
def module_size_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.size_summary(regions(spark, sf_dir))
    by_dim = F.array_join(F.transform("by_dim", lambda x: F.concat_ws(":", x["dim"].cast("string"), x["measure"].cast("long").cast("string"))), ",")
    return s.withColumns({"mean_dim": F.round("mean_dim", 6), "var_dim": F.round("var_dim", 6), "by_dim": by_dim})


COMPS = "reach AS (SELECT region AS a, region AS b FROM reg UNION SELECT reach.a, arc.v FROM reach JOIN arc ON arc.u = reach.b), comp AS (SELECT a, min(b) AS root FROM reach GROUP BY a)"


@query(
    "region_adjacency_stats",
    f"WITH RECURSIVE {ADJACENCY}, arc AS (SELECT r AS u, s AS v FROM adj UNION ALL SELECT s, r FROM adj), {COMPS}, ends AS (SELECT x.dim AS lu, y.dim AS lv FROM arc JOIN reg x ON x.region = u JOIN reg y ON y.region = v) "
    "SELECT (SELECT count(*) FROM reg) AS n_regions, (SELECT count(*) FROM adj) AS n_edges, (SELECT count(DISTINCT root) FROM comp) AS n_components, (SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY n DESC) FROM (SELECT count(*) AS n FROM comp GROUP BY root)) AS component_sizes, "
    "round((SELECT sum(CASE WHEN lu = lv THEN 1e0 ELSE 0 END) / count(*) FROM ends) - (SELECT sum(k * k) / (sum(k) * sum(k)) FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM ends GROUP BY lu)), 6) AS modularity",
)
def region_adjacency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.adjacency_stats(regions(spark, sf_dir), _adjacent(spark, sf_dir))
    return s.withColumns({"component_sizes": _text("component_sizes"), "modularity": F.round("modularity", 6)})


@query(
    "module_geometry_asymptotics",
    f"WITH {REGIONS}, w AS (SELECT s.scale, lab.i, lab.j, lab.region, reg.dim FROM lab JOIN reg USING (region), (VALUES (1e0), (2e0), (4e0), (8e0)) s(scale) WHERE i < s.scale * 7 AND j < s.scale * 2), "
    "z AS (SELECT scale, CAST(count(*) AS DOUBLE) AS measure, CAST(sum(dim) AS DOUBLE) AS mass FROM w GROUP BY scale), t AS (SELECT a.scale, CAST(count(*) AS DOUBLE) AS n FROM w a JOIN w b ON a.scale = b.scale AND a.region <> b.region AND ((b.i = a.i + 1 AND b.j = a.j) OR (b.i = a.i AND b.j = a.j + 1)) GROUP BY 1) "
    "SELECT z.scale, measure, mass, coalesce(n, 0) AS interface, round((SELECT regr_slope(ln(measure), ln(scale)) FROM z), 6) AS slope FROM z LEFT JOIN t ON t.scale = z.scale",
)
def module_geometry_asymptotics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.asymptotics(labels(spark, sf_dir), regions(spark, sf_dir), [1, 2, 4, 8], 7, 2).withColumn("slope", F.round("slope", 6))
