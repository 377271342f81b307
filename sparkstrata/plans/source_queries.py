"""Queries on exchange files (written from the nations' table, then read) and on synthetic objects."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import shared_dir
from ..operators import presentations as S
from ..sources import files, synthetic
from .registry import query
from .tables import read


def _file(lines: DataFrame, suffix: str = "txt") -> str:
    """``lines`` (``k, line``) as one text file, in order of k."""
    path = f"{shared_dir(lines.sparkSession)}/source-{uuid.uuid4().hex}.{suffix}"
    lines.orderBy("k").coalesce(1).select("line").write.text(path)
    return path


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("long").alias("r"))


NAT = "nat AS (SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) AS r FROM nation)"
DIST = f"{NAT}, dist AS (SELECT a.k AS u, b.k AS v, abs(a.k - b.k) + 0.5e0 * abs(a.r - b.r) AS d FROM nat a, nat b)"


def _rows(spark: SparkSession, sf_dir: str, keep: Column) -> DataFrame:
    """``k, line``: rows of the nations' distance matrix, of the columns that ``keep`` (on k and c) chooses."""
    n = _nations(spark, sf_dir)
    pairs = n.crossJoin(F.broadcast(n.select(F.col("k").alias("c"), F.col("r").alias("s"))))  # 25 nations
    cell = F.struct("c", (F.abs(F.col("k") - F.col("c")) + 0.5 * F.abs(F.col("r") - F.col("s"))).alias("d"))
    rows = pairs.filter(keep).groupBy("k").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return rows.select("k", F.array_join(F.transform("cells", lambda x: x["d"].cast("string")), " ").alias("line"))


for _part, _keep in (("full", "true"), ("lower", "c <= k"), ("upper", "c >= k")):

    def _matrix(spark: SparkSession, sf_dir: str, part: str = _part, keep: str = _keep) -> DataFrame:
        return files.distance_matrix(spark, _file(_rows(spark, sf_dir, F.expr(keep))), part)

    query(f"file_{_part}_distance", f"WITH {DIST} SELECT u, v, d FROM dist WHERE u < v")(_matrix)


@query("file_distance_radius", f"WITH {DIST} SELECT u, v, d FROM dist WHERE u < v AND d <= 4")
def file_distance_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.distance_matrix(spark, _file(_rows(spark, sf_dir, F.expr("c < k"))), "lower", 4.0)


@query("file_sparse_triplet", f"WITH {DIST} SELECT u, v, d FROM dist WHERE u < v")
def file_sparse_triplet(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nations(spark, sf_dir)
    pairs = n.crossJoin(F.broadcast(n.select(F.col("k").alias("c"), F.col("r").alias("s")))).filter("c < k")  # 25 nations
    d = F.abs(F.col("k") - F.col("c")) + 0.5 * F.abs(F.col("r") - F.col("s"))
    return files.sparse_distances(spark, _file(pairs.select("k", F.concat_ws(" ", "k", "c", d.cast("string")).alias("line"))))


@query("file_point_cloud", f"WITH {NAT} SELECT k AS pid, k + 0.25e0 AS x, CAST(r AS DOUBLE) AS y FROM nat")
def file_point_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _nations(spark, sf_dir).select("k", F.concat_ws(" ", (F.col("k") + 0.25).cast("string"), "r").alias("line"))
    return files.points(spark, _file(lines)).select("pid", F.get("coords", F.lit(0)).alias("x"), F.get("coords", F.lit(1)).alias("y"))


def _with_header(df: DataFrame, header: str) -> DataFrame:
    return df.unionByName(df.sparkSession.createDataFrame([(-1, header)], "k long, line string"))


@query("file_point_table", f"WITH {NAT} SELECT k + 0.5e0 AS x, CAST(r AS DOUBLE) AS y FROM nat")
def file_point_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _nations(spark, sf_dir).select("k", F.concat_ws(",", (F.col("k") + 0.5).cast("string"), "r").alias("line"))
    return files.point_table(spark, _file(_with_header(lines, "x,y"), "csv")).select(F.get("coords", F.lit(0)).alias("x"), F.get("coords", F.lit(1)).alias("y"))


@query("file_edge_table", f"WITH {NAT} SELECT k + 1 AS u, k + 2 + r AS v, r + 0.5e0 AS w FROM nat")
def file_edge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _nations(spark, sf_dir).select("k", F.concat_ws(",", F.col("k") + 2 + F.col("r"), F.col("k") + 1, (F.col("r") + 0.5).cast("string")).alias("line"))
    return files.edge_table(spark, _file(_with_header(lines, "u,v,w"), "csv"))


@query("file_image", f"WITH {NAT} SELECT k AS i, CAST(j AS BIGINT) AS j, CAST(CASE j WHEN 0 THEN k ELSE r END AS DOUBLE) AS value FROM nat, range(2) g(j)")
def file_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.image_table(spark, _file(_nations(spark, sf_dir).select("k", F.concat_ws(",", "k", "r").alias("line"))))


SIMPLEX = f"WITH {NAT} SELECT k || ',' || (k + 1 + r) AS verts, r + 0.5e0 AS grade FROM nat"


def _simplices(df: DataFrame) -> DataFrame:
    return df.select(F.array_join(F.transform("verts", lambda x: x.cast("string")), ",").alias("verts"), "grade")


@query("file_simplex_lines", SIMPLEX)
def file_simplex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _nations(spark, sf_dir).select("k", F.concat_ws(" ", F.lit("1"), "k", F.col("k") + 1 + F.col("r"), (F.col("r") + 0.5).cast("string")).alias("line"))
    return _simplices(files.simplex_lines(spark, _file(lines)))


@query("file_simplex_lines_plain", SIMPLEX)
def file_simplex_lines_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _nations(spark, sf_dir).select("k", F.concat_ws(" ", "k", F.col("k") + 1 + F.col("r"), (F.col("r") + 0.5).cast("string")).alias("line"))
    return _simplices(files.simplex_lines(spark, _file(lines), with_dim=False))


@query("file_simplex_json", SIMPLEX)
def file_simplex_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nations(spark, sf_dir).groupBy(F.lit(0).cast("long").alias("k")).agg(F.sort_array(F.collect_list(F.struct("k", "r"))).alias("x"))  # 25 nations
    one = rows.select("k", F.to_json(F.struct(F.transform("x", lambda t: F.array(t["k"], t["k"] + 1 + t["r"])).alias("simplices"), F.transform("x", lambda t: t["r"] + 0.5).alias("filtration"))).alias("line"))
    return _simplices(files.simplex_json(spark, _file(one, "json")))


@query("file_bifiltration", f"WITH {NAT} SELECT CAST(k AS VARCHAR) AS verts, CAST(r AS DOUBLE) AS g1, 2.5e0 AS g2 FROM nat UNION ALL SELECT CAST(k AS VARCHAR), r + 1e0, 1.5e0 FROM nat")
def file_bifiltration(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _nations(spark, sf_dir).select("k", F.concat("k", F.lit(" ; "), "r", F.lit(" 2.5 "), F.col("r") + 1, F.lit(" 1.5")).alias("line"))
    df = files.bifiltration(spark, _file(_with_header(lines, "--datatype bifiltration")))
    return df.select(F.array_join(F.transform("verts", lambda x: x.cast("string")), ",").alias("verts"), "g1", "g2")


for _format in ("csv", "parquet"):

    def _features(spark: SparkSession, sf_dir: str, format: str = _format) -> DataFrame:  # noqa: A002
        path = f"{shared_dir(spark)}/features-{uuid.uuid4().hex}"
        files.save_features(_nations(spark, sf_dir).withColumn("f", F.col("r") / 2), path, format)
        return files.load_features(spark, path, format).select(F.col("k").cast("long"), F.col("r").cast("long"), F.col("f").cast("double"))

    query(f"file_features_{_format}", f"WITH {NAT} SELECT k, r, r / 2e0 AS f FROM nat")(_features)


@query("file_load_points", f"WITH {NAT} SELECT k + 0.5e0 AS x, CAST(r AS DOUBLE) AS y FROM nat")
def file_load_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delimited file whose kind is found by looking at it."""
    lines = _nations(spark, sf_dir).select("k", F.concat_ws(",", (F.col("k") + 0.5).cast("string"), "r").alias("line"))
    return files.load(spark, _file(_with_header(lines, "x,y"), "csv")).select(F.get("coords", F.lit(0)).alias("x"), F.get("coords", F.lit(1)).alias("y"))


@query("file_load_graph", f"WITH {NAT} SELECT k + 1 AS u, k + 2 + r AS v, 1e0 AS w FROM nat")
def file_load_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _nations(spark, sf_dir).select("k", F.concat_ws("\t", F.col("k") + 2 + F.col("r"), F.col("k") + 1).alias("line"))
    return files.load(spark, _file(_with_header(lines, "u\tv"), "tsv"))


@query("file_load_distance", f"WITH {DIST} SELECT u, v, d FROM dist WHERE u < v AND d <= 6")
def file_load_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.load(spark, _file(_rows(spark, sf_dir, F.expr("c <= k"))), "distance", part="lower", radius=6.0)


# ---- synthetic objects ----


def _fibers(found: DataFrame, phi: DataFrame) -> DataFrame:
    dims = S.fiber_dimensions(found.select("ups", "downs").distinct(), phi)
    return found.join(dims, ["ups", "downs"])


def _chain(spark: SparkSession, gens: DataFrame, n: int) -> DataFrame:
    rows = spark.range(1, n + 1).select(F.col("id").cast("int").alias("q")).join(F.broadcast(gens))  # a presentation's bars
    held = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("gen"))))
    return rows.groupBy("q").agg(held(F.col("birth") <= F.col("q")).alias("ups"), held(F.col("q") <= F.col("death")).alias("downs"))


@query("synthetic_chain_fringe", "SELECT CAST(q AS INTEGER) AS q, CAST((q BETWEEN 1 AND 4)::INT + (q BETWEEN 2 AND 5)::INT + (q BETWEEN 3 AND 6)::INT AS INTEGER) AS dim FROM range(1, 7) r(q)")
def synthetic_chain_fringe(spark: SparkSession, sf_dir: str) -> DataFrame:
    gens, phi = synthetic.chain_fringe(spark, [(1, 4), (2, 5), (3, 6)])
    return _fibers(_chain(spark, gens, 6), phi).select("q", "dim")


@query("synthetic_coupled_chain_fringe", "SELECT CAST(q AS INTEGER) AS q, CAST(dim AS INTEGER) AS dim FROM (VALUES (1, 1), (2, 2), (3, 3), (4, 3), (5, 2), (6, 1)) v(q, dim)")
def synthetic_coupled_chain_fringe(spark: SparkSession, sf_dir: str) -> DataFrame:
    gens, phi = synthetic.chain_fringe(spark, [(1, 4), (2, 5), (3, 6)], coupled=True)
    return _fibers(_chain(spark, gens, 6), phi).select("q", "dim")


@query("synthetic_diamond_fringe", "SELECT CAST(q AS INTEGER) AS q, CAST(dim AS INTEGER) AS dim FROM (VALUES (1, 0), (2, 1), (3, 1), (4, 1)) v(q, dim)")
def synthetic_diamond_fringe(spark: SparkSession, sf_dir: str) -> DataFrame:
    gens, phi = synthetic.diamond_fringe(spark)
    order = spark.createDataFrame([(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3, 4) if a == b or a == 1 or b == 4], "a int, b int")
    up = S.upset_closure(gens.filter("kind = 'up'").select("gen", "q"), order)
    down = S.downset_closure(gens.filter("kind = 'down'").select("gen", "q"), order)
    at = order.select(F.col("a").alias("q")).distinct()
    sets = lambda t, name: t.groupBy("q").agg(F.array_sort(F.collect_set("gen")).alias(name))
    none = F.array().cast("array<int>")
    found = at.join(sets(up, "ups"), "q", "left").join(sets(down, "downs"), "q", "left").select("q", F.coalesce("ups", none).alias("ups"), F.coalesce("downs", none).alias("downs"))
    return _fibers(found, phi).select("q", "dim")


STAIRS = "box(g, a, b, c, d) AS (VALUES (0, 0e0, 0e0, 1.5e0, 1e0), (1, 0.75e0, 0.5e0, 2.5e0, 2e0), (2, 1.5e0, 1e0, 3.5e0, 3e0)), px AS (SELECT a AS x FROM box UNION SELECT c FROM box), py AS (SELECT b AS y FROM box UNION SELECT d FROM box)"


def _box_fibers(spark: SparkSession, gens: DataFrame, phi: DataFrame) -> DataFrame:
    return _fibers(S.signatures(S.cells(gens), gens), phi).select("x", "y", "dim")


@query("synthetic_box_fringe", f"WITH {STAIRS} SELECT x, y, CAST((SELECT count(*) FROM box WHERE a <= x AND x <= c AND b <= y AND y <= d) AS INTEGER) AS dim FROM px, py")
def synthetic_box_fringe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _box_fibers(spark, *synthetic.box_fringe(spark))


# Of the bidiagonal matrix on the upsets 0..u and the downsets l..2 the rank is the number of rows that meet a column: those up to u.
@query("synthetic_staircase_fringe", f"WITH {STAIRS}, s AS (SELECT x, y, (SELECT max(g) FROM box WHERE a <= x AND b <= y) AS u, (SELECT min(g) FROM box WHERE x <= c AND y <= d) AS l FROM px, py) SELECT x, y, CAST(CASE WHEN u IS NULL OR l IS NULL THEN 0 ELSE least(3 - l, CASE WHEN l = 0 THEN u + 1 ELSE greatest(u - l + 1, 0) END) END AS INTEGER) AS dim FROM s")
def synthetic_staircase_fringe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _box_fibers(spark, *synthetic.box_fringe(spark, coupled=True))


@query("synthetic_pl_fringe", f"WITH {STAIRS.split(', px AS')[0]} SELECT g AS gen, kind, 0 AS part, CAST(r AS INTEGER) AS row, CASE WHEN r = 0 THEN s ELSE 0e0 END AS ax, CASE WHEN r = 1 THEN s ELSE 0e0 END AS ay, CASE kind WHEN 'up' THEN CASE r WHEN 0 THEN 0e0 - a ELSE 0e0 - b END ELSE CASE r WHEN 0 THEN c ELSE d END END AS b FROM box, (VALUES ('up', -1e0), ('down', 1e0)) k(kind, s), range(2) rr(r)")
def synthetic_pl_fringe(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = synthetic.halfspaces(synthetic.box_fringe(spark)[0])
    plain = lambda i: F.get("a", F.lit(i)) + 0.0  # noqa: E731  (-0 is 0)
    return h.select("gen", "kind", "part", "row", plain(0).alias("ax"), plain(1).alias("ay"), (F.col("b") + 0.0).alias("b"))


@query("synthetic_mixed_flange", "WITH u(g, a, b) AS (VALUES (0, NULL, 0), (1, 0, NULL), (2, 1, 1)), d(g, c, e) AS (VALUES (0, NULL, 2), (1, 2, NULL), (2, 3, 3)), p AS (SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (VALUES (0), (1), (2), (3)) a(x), (VALUES (0), (1), (2), (3)) b(y)) SELECT x, y, CAST((SELECT count(*) FROM u WHERE (a IS NULL OR a <= x) AND (b IS NULL OR b <= y)) AS INTEGER) AS n_ups, CAST((SELECT count(*) FROM d WHERE (c IS NULL OR x <= c) AND (e IS NULL OR y <= e)) AS INTEGER) AS n_downs FROM p")
def synthetic_mixed_flange(spark: SparkSession, sf_dir: str) -> DataFrame:
    gens, _ = synthetic.mixed_face_flange(spark)
    return S.signatures(S.cells(gens), gens).select("x", "y", F.size("ups").alias("n_ups"), F.size("downs").alias("n_downs"))


@query("synthetic_grid_graph", "SELECT r * 6 + c AS u, r * 6 + c + 1 AS v FROM range(4) a(r), range(5) b(c) UNION ALL SELECT r * 6 + c, r * 6 + c + 6 FROM range(3) a(r), range(6) b(c)")
def synthetic_grid_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.planar_grid_graph(spark, 4, 6)


@query("synthetic_checkerboard", "SELECT i, j, CAST((i // 2 + j // 2) % 2 AS DOUBLE) AS value FROM range(8) a(i), range(8) b(j)")
def synthetic_checkerboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.checkerboard(spark, 8, 2)


@query("synthetic_sweep", "SELECT 'rows=' || m || ',cols=' || n AS label, (m * (n - 1) + n * (m - 1)) AS edges FROM (VALUES (2), (3)) a(m), (VALUES (2), (5)) b(n)")
def synthetic_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = synthetic.sweep(synthetic.planar_grid_graph, {"rows": [2, 3], "cols": [2, 5]}, spark=spark)
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("edges"))


ORBIT = "o AS (SELECT 0 AS k, 0.3e0 AS x, 0.6e0 AS y UNION ALL SELECT k + 1, (x + y * (1 - y)) % 1e0, (y + ((x + y * (1 - y)) % 1e0) * (1 - ((x + y * (1 - y)) % 1e0))) % 1e0 FROM o WHERE k < 19)"


@query("synthetic_coupled_orbit", f"WITH RECURSIVE {ORBIT} SELECT k, round(x, 6) AS x, round(y, 6) AS y FROM o")
def synthetic_coupled_orbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(synthetic.coupled_orbit(20, 0.3, 0.6), "k int, x double, y double").select("k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
