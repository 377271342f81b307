"""Queries on feature vectors of suppliers' diagrams and signed measures."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import shared_dir
from ..operators import features as V
from .registry import query
from .tables import BARS, bars, read

TS = (5.0, 15.0, 25.0, 35.0, 45.0)
XS, YS = (0.0, 2.0, 4.0), (2.0, 5.0, 10.0)
MEAS = "meas AS (SELECT l_suppkey AS id, CAST(floor(l_quantity / 10) AS BIGINT) AS i, CAST(round_even(l_discount*100, 0) AS BIGINT) AS j, CASE WHEN l_returnflag = 'R' THEN -2 ELSE 1 END AS w FROM lineitem)"
TERM = f"{MEAS}, term AS (SELECT id, i, j, CAST(sum(w) AS BIGINT) AS w FROM meas GROUP BY ALL HAVING sum(w) <> 0)"
TAB = f"{BARS}, ts AS (SELECT * FROM (VALUES {', '.join(f'({k}, {t}e0)' for k, t in enumerate(TS, 1))}) v(ta, t))"
GX = f"(VALUES {', '.join(f'({k}, {t}e0)' for k, t in enumerate(XS, 1))}) gx(xa, xv)"
GY = f"(VALUES {', '.join(f'({k}, {t}e0)' for k, t in enumerate(YS, 1))}) gy(ya, yv)"


def _source(spark: SparkSession, sf_dir: str) -> V.Source:
    item = read(spark, sf_dir, "lineitem")
    w = F.when(F.col("l_returnflag") == "R", -2).otherwise(1)
    measure = item.select(F.col("l_suppkey").alias("id"), F.floor(F.col("l_quantity") / 10).cast("long").alias("i"), F.rint(F.col("l_discount") * 100).cast("long").alias("j"), w.alias("w"))
    return {"bars": bars(spark, sf_dir).withColumnRenamed("slice", "id"), "measure": measure}


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumn("value", F.round("value", digits))


TENT = f"{TAB}, h AS (SELECT slice, ta, least(t - birth, death - t) AS h, mult AS m FROM bars JOIN ts ON t > birth AND t < death), hs AS (SELECT slice, ta, h, sum(m) AS m FROM h GROUP BY ALL), o AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY slice, ta ORDER BY h DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM hs)"


@query("features_landscape", f"WITH {TENT} SELECT slice AS id, 'landscape__k' || k || '_t' || ta AS feature, CAST(h AS DOUBLE) AS value FROM o JOIN range(1, 4) ks(k) ON k > b AND k <= b + m")
def features_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.transform(V.Landscape(TS, 3), _source(spark, sf_dir))


IMAGE = f"sum((death - birth) * mult * exp(-(power(xv * 10 - birth, 2) + power(yv - (death - birth), 2)) / 50e0))"


@query("features_persistence_image", f"WITH {TAB} SELECT slice AS id, 'persistence_image__x' || xa || '_y' || ya AS feature, round({IMAGE}, 4) AS value FROM bars, {GX}, {GY} GROUP BY slice, xa, ya")
def features_persistence_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(V.transform(V.PersistenceImage(tuple(10 * x for x in XS), YS, 5.0), _source(spark, sf_dir)), 4)


TOP = "f AS (SELECT slice, birth, death - birth AS life, sum(mult) AS m FROM bars GROUP BY ALL), o AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY slice ORDER BY life DESC, birth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM f), top AS (SELECT slice, k, birth, life FROM o JOIN range(1, 4) ks(k) ON k > b AND k <= b + m)"


@query("features_barcode_topk", f"WITH {BARS}, {TOP} SELECT slice AS id, 'barcode__bar' || k || '__birth' AS feature, CAST(birth AS DOUBLE) AS value FROM top UNION ALL SELECT slice, 'barcode__bar' || k || '__persistence', life FROM top")
def features_barcode_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.transform(V.BarcodeTopK(3), _source(spark, sf_dir))


SUMS = f"{BARS}, s AS (SELECT slice AS id, CAST(sum(mult) AS DOUBLE) AS n_bars, CAST(sum((death - birth) * mult) AS DOUBLE) AS total, CAST(max(death - birth) AS DOUBLE) AS longest, round(sum((death - birth) * mult) / CAST(sum(mult) AS DOUBLE), 6) AS mean, round(sqrt(sum((death - birth) * (death - birth) * mult)), 6) AS l2 FROM bars GROUP BY slice)"


@query("features_barcode_summary", f"WITH {SUMS} SELECT id, 'barcode__' || f AS feature, value FROM (UNPIVOT s ON n_bars, total, longest, mean, l2 INTO NAME f VALUE value)")
def features_barcode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(V.transform(V.BarcodeSummary(), _source(spark, sf_dir)))


@query("features_euler_surface", f"WITH {TERM} SELECT id, 'euler__x' || xa || '_y' || ya AS feature, CAST(sum(w) AS DOUBLE) AS value FROM term JOIN {GX} ON i <= xv JOIN {GY} ON j <= yv GROUP BY id, xa, ya HAVING sum(w) <> 0")
def features_euler_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.transform(V.EulerSurface(XS, YS), _source(spark, sf_dir))


@query("features_rank_grid", f"WITH {TAB} SELECT slice AS id, 'rank__p' || p.ta || '_q' || q.ta AS feature, CAST(sum(mult) AS DOUBLE) AS value FROM bars JOIN ts p ON birth <= p.t JOIN ts q ON p.ta <= q.ta AND q.t < death GROUP BY slice, p.ta, q.ta")
def features_rank_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.transform(V.RankGrid(TS), _source(spark, sf_dir))


@query("features_restricted_hilbert", f"WITH {TAB} SELECT slice AS id, 'hilbert__t' || ta AS feature, CAST(sum(mult) AS DOUBLE) AS value FROM bars JOIN ts ON birth <= t AND t < death GROUP BY slice, ta")
def features_restricted_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.transform(V.RestrictedHilbert(TS), _source(spark, sf_dir))


for _name, _spec, _cols in (("point_signed_measure", V.PointSignedMeasure(3), ("i", "j", "w")), ("euler_signed_measure", V.EulerSignedMeasure(3), ("i", "j", "w"))):

    def _measure(spark: SparkSession, sf_dir: str, spec: V.Spec = _spec) -> DataFrame:
        return V.transform(spec, _source(spark, sf_dir))

    query(
        f"features_{_name}",
        f"WITH {TERM}, top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(w) DESC, i, j) AS r FROM term) " + " UNION ALL ".join(f"SELECT id, '{_name}__term' || r || '__{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM top WHERE r <= 3" for c in _cols),
    )(_measure)


@query(
    "features_rectangle_topk",
    f"WITH {BARS}, f AS (SELECT slice AS id, birth AS lo, death - 1 AS hi, CAST(sum(mult) AS BIGINT) AS w FROM bars GROUP BY ALL), top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, lo, hi) AS r FROM f) "
    + " UNION ALL ".join(f"SELECT id, 'rectangle__term' || r || '__{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM top WHERE r <= 3" for c in ("lo", "hi", "w")),
)
def features_rectangle_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.transform(V.RectangleTopK(3), _source(spark, sf_dir))


@query("features_signed_barcode_image", f"WITH {TERM} SELECT id, 'signed_barcode_image__x' || xa || '_y' || ya AS feature, round(sum(w * exp(-(power(i - xv, 2) + power(j - yv, 2)) / 8e0)), 5) AS value FROM term, {GX}, {GY} GROUP BY id, xa, ya")
def features_signed_barcode_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(V.transform(V.SignedBarcodeImage(XS, YS, 2.0), _source(spark, sf_dir)), 5)


MPL = (
    "sb AS (SELECT l_suppkey AS id, CAST(l_linenumber AS BIGINT) AS slice, CAST(l_quantity AS BIGINT) AS birth, CAST(l_quantity AS BIGINT) + 1 + CAST(round_even(l_discount*100, 0) AS BIGINT) AS death, count(*) AS mult FROM lineitem GROUP BY ALL), "
    f"ts AS (SELECT * FROM (VALUES {', '.join(f'({k}, {t}e0)' for k, t in enumerate(TS, 1))}) v(ta, t)), hs AS (SELECT id, slice, ta, least(t - birth, death - t) AS h, sum(mult) AS m FROM sb JOIN ts ON t > birth AND t < death GROUP BY ALL), "
    "o AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY id, slice, ta ORDER BY h DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM hs), wt AS (SELECT id, sum(slice) AS w FROM (SELECT DISTINCT id, slice FROM sb) GROUP BY id)"
)


@query("features_mp_landscape", f"WITH {MPL} SELECT o.id, 'mp_landscape__k' || k || '_t' || ta AS feature, round(sum(h * slice) / max(w), 6) AS value FROM o JOIN range(1, 3) ks(k) ON k > b AND k <= b + m JOIN wt ON wt.id = o.id GROUP BY o.id, k, ta")
def features_mp_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices are line numbers, which are their weights too."""
    item = read(spark, sf_dir, "lineitem")
    b = F.col("l_quantity").cast("long")
    rows = item.groupBy(F.col("l_suppkey").alias("id"), F.col("l_linenumber").cast("long").alias("slice"), b.alias("birth"), (b + 1 + F.rint(F.col("l_discount") * 100).cast("long")).alias("death")).agg(F.count(F.lit(1)).alias("mult"))
    return _rounded(V.transform(V.MPLandscape(TS, 2), {"slices": rows.withColumn("weight", F.col("slice").cast("double"))}))


@query("features_distance_bank")
def features_distance_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottleneck distances to two fixed diagrams; tests hold the kernel against all matchings."""
    refs = spark.createDataFrame([("short", 1, 3, 5), ("short", 20, 22, 5), ("long", 1, 40, 1)], "name string, birth long, death long, mult long")
    return V.transform(V.DistanceBank(("short", "long")), _source(spark, sf_dir) | {"references": refs})


COMPOSITE = V.Composite((V.BarcodeSummary(("n_bars", "total")), V.RestrictedHilbert((5.0, 25.0)), V.EulerSurface((2.0,), (5.0,))))


@query(
    "features_composite",
    f"WITH {BARS}, {TERM} SELECT slice AS id, CAST(sum(mult) AS DOUBLE) AS barcode__n_bars, CAST(sum((death - birth) * mult) AS DOUBLE) AS barcode__total, coalesce(CAST(sum(CASE WHEN birth <= 5 AND 5 < death THEN mult END) AS DOUBLE), 0) AS hilbert__t1, "
    "coalesce(CAST(sum(CASE WHEN birth <= 25 AND 25 < death THEN mult END) AS DOUBLE), 0) AS hilbert__t2, coalesce((SELECT CAST(sum(w) AS DOUBLE) FROM term WHERE term.id = slice AND i <= 2 AND j <= 5), 0) AS euler__x1_y1 FROM bars GROUP BY slice",
)
def features_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.featurize(COMPOSITE, _source(spark, sf_dir))


@query("feature_names", "SELECT CAST(k AS INTEGER) AS k, name FROM (VALUES " + ", ".join(f"({k}, '{n}')" for k, n in enumerate(["barcode__n_bars", "barcode__total", "hilbert__t1", "hilbert__t2", "euler__x1_y1"])) + ") v(k, name)")
def feature_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(COMPOSITE.names())), "k int, name string")


@query(
    "feature_experiment",
    f"WITH {TAB} SELECT 'hilbert' AS experiment, slice AS id, 'hilbert__t' || ta AS feature, CAST(sum(mult) AS DOUBLE) AS value, 5 AS n_features FROM bars JOIN ts ON birth <= t AND t < death GROUP BY slice, ta "
    "UNION ALL SELECT 'size', slice, 'barcode__n_bars', CAST(sum(mult) AS DOUBLE), 1 FROM bars GROUP BY slice",
)
def feature_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two specs run, written and loaded again."""
    path = f"{shared_dir(spark)}/experiment-{uuid.uuid4().hex}"
    V.run_experiment(path, {"hilbert": V.RestrictedHilbert(TS), "size": V.BarcodeSummary(("n_bars",))}, _source(spark, sf_dir))
    manifest, rows = V.load_experiment(spark, path)
    return rows.join(manifest.select("experiment", "n_features"), "experiment").select("experiment", "id", "feature", "value", "n_features")
