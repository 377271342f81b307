"""Queries on flanges, slice plans, slice kernels, graph and drawing filtrations, and Kan extensions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import shared_dir
from ..operators import bars as B
from ..operators import filtrations as T
from ..operators import flanges as L
from ..operators import modules as M
from ..operators import slices as S
from ..sources import files
from .bar_queries import slice_weights
from .module_queries import CHAIN, COVERS, SPANS, _spans
from .registry import query
from .tables import GRAPH, POINTS, graph, points, read

# A flange over Z^2 from the nations: box (region, key modulo 4) to (+2, +3); every fifth key is free upwards in y, every
# seventh downwards in x. phi is diagonal, so the module is the sum of the boxes.
FLANGE = (
    "fl AS (SELECT CAST(n_nationkey AS INTEGER) AS gen, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE CAST(n_regionkey AS BIGINT) END AS lx, CAST(n_nationkey % 4 AS BIGINT) AS ly, "
    "CAST(n_regionkey + 2 AS BIGINT) AS hx, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE CAST(n_nationkey % 4 + 3 AS BIGINT) END AS hy FROM nation), "
    "pt AS (SELECT x, y FROM range(-1, 8) a(x), range(-1, 9) b(y))"
)
_LOW, _HIGH = (-1, -1), (7, 8)
_IN = "(lx IS NULL OR lx <= x) AND ly <= y AND x {dx} <= hx AND (hy IS NULL OR y {dy} <= hy)"


def _flange(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, none = F.col("n_nationkey"), F.lit(None).cast("long")
    n = read(spark, sf_dir, "nation").select(
        k.cast("int").alias("gen"), F.when(k % 7 == 0, none).otherwise(F.col("n_regionkey").cast("long")).alias("lx"), (k % 4).cast("long").alias("ly"),
        (F.col("n_regionkey") + 2).cast("long").alias("hx"), F.when(k % 5 == 0, none).otherwise((k % 4 + 3).cast("long")).alias("hy"),
    )
    up = n.select("gen", F.lit("up").alias("kind"), F.col("lx").alias("lo_x"), F.col("ly").alias("lo_y"), none.alias("hi_x"), none.alias("hi_y"))
    down = n.select("gen", F.lit("down").alias("kind"), none.alias("lo_x"), none.alias("lo_y"), F.col("hx").alias("hi_x"), F.col("hy").alias("hi_y"))
    one = F.lit(1).cast("long")
    return up.unionByName(down), n.select(F.col("gen").alias("down"), F.col("gen").alias("up"), one.alias("num"), one.alias("den"))


_SUM = ", ".join(f"(SELECT count(*) FROM fl WHERE {_IN.format(dx=dx, dy=dy)})" for dx, dy in (("", ""), ("+ 1", ""), ("", "+ 1")))


@query("flange_module_on_box", f"WITH {FLANGE}, m AS (SELECT x, y, {_SUM} FROM pt), r(x, y, dim, rx, ry) AS (SELECT * FROM m) SELECT x, y, dim, CASE WHEN x < 7 THEN rx END AS rank_x, CASE WHEN y < 8 THEN ry END AS rank_y FROM r")
def flange_module_on_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions and ranks of one step up on a lattice window."""
    return L.module_on_box(spark, *_flange(spark, sf_dir), _LOW, _HIGH)


@query("flange_degree_matrix", f"WITH {FLANGE} SELECT x, y, gen AS down, gen AS up, CAST(1 AS BIGINT) AS num, CAST(1 AS BIGINT) AS den FROM fl JOIN (SELECT DISTINCT CAST(n_regionkey AS BIGINT) AS x, CAST(n_nationkey % 6 AS BIGINT) AS y FROM nation) g ON {_IN.format(dx='', dy='')}")
def flange_degree_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active rows and columns at the points (region, key modulo 6)."""
    at = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("x"), (F.col("n_nationkey") % 6).alias("y"))
    return L.degree_matrix(*_flange(spark, sf_dir), at)


def _doubled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The flange with a second copy of every generator: upsets 100 + k times 3, downsets 200 + k times -2 / 5 of theirs."""
    gens, phi = _flange(spark, sf_dir)
    up, down = gens.filter("kind = 'up'"), gens.filter("kind = 'down'")
    gens = gens.unionByName(up.withColumn("gen", F.col("gen") + 100)).unionByName(down.withColumn("gen", F.col("gen") + 200))
    phi = phi.unionByName(phi.select("down", (F.col("up") + 100).alias("up"), (F.col("num") * 3).alias("num"), "den"))
    return gens, phi.unionByName(phi.select((F.col("down") + 200).alias("down"), "up", (F.col("num") * -2).alias("num"), (F.col("den") * 5).alias("den")))


# Generators are compared with the first one of their bounds: its copy goes, copies of later ones stay.
_FIRST = "m AS (SELECT gen, gen = min(gen) OVER (PARTITION BY lx, ly) AS u, gen = min(gen) OVER (PARTITION BY hx, hy) AS d FROM fl)"


@query("flange_minimize", f"WITH {FLANGE}, {_FIRST} SELECT gen, 'up' AS kind FROM m UNION ALL SELECT gen + 100, 'up' FROM m WHERE NOT u UNION ALL SELECT gen, 'down' FROM m UNION ALL SELECT gen + 200, 'down' FROM m WHERE NOT d")
def flange_minimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.minimize(*_doubled(spark, sf_dir))[0].select("gen", "kind")


@query(
    "flange_to_axis",
    f"WITH {FLANGE} SELECT gen, 'up' AS kind, concat_ws(',', coalesce(CAST(lx AS VARCHAR), '*'), CAST(ly AS VARCHAR)) AS corner FROM fl UNION ALL SELECT gen, 'down', concat_ws(',', CAST(hx AS VARCHAR), coalesce(CAST(hy AS VARCHAR), '*')) FROM fl",
)
def flange_to_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.transform(F.arrays_zip("corner", "free"), lambda c: F.when(c["free"], F.lit("*")).otherwise(c["corner"].cast("string")))
    return L.to_axis(_flange(spark, sf_dir)[0]).select("gen", "kind", F.array_join(place, ",").alias("corner"))


@query(
    "flange_json",
    f"WITH {FLANGE}, num AS (SELECT *, CAST(row_number() OVER (ORDER BY gen) - 1 AS INTEGER) AS i FROM fl) SELECT i AS gen, 'up' AS kind, lx AS x, ly AS y, CAST(i AS VARCHAR) || ':-2/7' AS phi FROM num UNION ALL SELECT i, 'down', hx, hy, CAST(i AS VARCHAR) || ':-2/7' FROM num",
)
def flange_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved, loaded and shown with each generator's entries of phi, here -2/7 on the diagonal."""
    gens, phi = _flange(spark, sf_dir)
    path = f"{shared_dir(spark)}/flange-{uuid.uuid4().hex}.json"
    files.save_flange_json(gens, phi.withColumn("num", F.lit(-2).cast("long")).withColumn("den", F.lit(7).cast("long")), path)
    gens, phi = files.load_flange_json(spark, path)
    text = lambda c: F.concat(F.col(c), F.lit(":"), "num", F.lit("/"), "den")
    entry = phi.select(F.col("up").alias("gen"), F.lit("up").alias("kind"), text("down").alias("phi")).unionByName(phi.select(F.col("down").alias("gen"), F.lit("down").alias("kind"), text("up").alias("phi")))
    return gens.join(entry, ["gen", "kind"], "left").select("gen", "kind", F.coalesce("lo_x", "hi_x").alias("x"), F.coalesce("lo_y", "hi_y").alias("y"), "phi")


# Slice plans

_DIRS = "dir AS (SELECT a.k AS a, b.k AS b, row_number() OVER (ORDER BY b.k / CAST(a.k AS DOUBLE)) AS p FROM range(1, 9) a(k), range(1, 9) b(k) WHERE gcd(a.k, b.k) = 1)"


@query("default_directions", f"WITH {_DIRS} SELECT round(a / CAST(a + b AS DOUBLE), 9) AS dx, round(b / CAST(a + b AS DOUBLE), 9) AS dy FROM dir WHERE p IN (SELECT CAST(round(1 + k * ((SELECT count(*) FROM dir) - 1) / 15e0) AS BIGINT) FROM range(16) r(k))")
def default_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(x, 9), round(y, 9)) for x, y in S.default_directions(2, 16, 8)], "dx double, dy double")


_D3 = "d3 AS (SELECT a.k AS a, b.k AS b, c.k AS c, row_number() OVER (ORDER BY a.k / CAST(a.k + b.k + c.k AS DOUBLE), b.k / CAST(a.k + b.k + c.k AS DOUBLE)) AS p FROM range(0, 4) a(k), range(0, 4) b(k), range(0, 4) c(k) WHERE gcd(gcd(a.k, b.k), c.k) = 1)"


@query("default_directions_3d", f"WITH {_D3} SELECT round(a / CAST(greatest(a, b, c) AS DOUBLE), 9) AS dx, round(b / CAST(greatest(a, b, c) AS DOUBLE), 9) AS dy, round(c / CAST(greatest(a, b, c) AS DOUBLE), 9) AS dz FROM d3")
def default_directions_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.default_directions(3, 1000, 3, True, "linf")
    return spark.createDataFrame([tuple(round(x, 9) for x in v) for v in rows], "dx double, dy double, dz double")


BOX2 = f"{POINTS}, ends AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM p)"
_BOX5 = f"{BOX2}, box AS (SELECT a - (b - a) * 0.05e0 AS lx, b + (b - a) * 0.05e0 AS hx, c - (d - c) * 0.05e0 AS ly, d + (d - c) * 0.05e0 AS hy FROM ends)"


def _nine(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if c in columns else c for c in df.columns))


def _box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bounding_box(points(spark, sf_dir), ("x", "y"))


@query("encoding_box", f"WITH {_BOX5} SELECT round(lx, 9) AS lo_x, round(hx, 9) AS hi_x, round(ly, 9) AS lo_y, round(hy, 9) AS hi_y FROM box")
def encoding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nine(_box(spark, sf_dir), "lo_x", "hi_x", "lo_y", "hi_y")


@query("window_box", "SELECT floor(min(l_quantity) - (max(l_quantity) - min(l_quantity)) * 0.05e0 - 0.25e0) AS lo_x, ceil(max(l_quantity) + (max(l_quantity) - min(l_quantity)) * 0.05e0 + 0.25e0) AS hi_x, floor(7 - 1 - 0.1e0 - 0.25e0) AS lo_y, ceil(7 + 1 + 0.1e0 + 0.25e0) AS hi_y FROM lineitem")
def window_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second side has no length and is opened first; ends are rounded outwards."""
    reps = read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.lit(7.0).alias("y"))
    return S.window(reps, ("x", "y"), padding=0.25, whole=True)


@query("default_offsets", f"WITH {_BOX5} SELECT CAST(k AS INTEGER) AS k, round(lx + k / 8e0 * (hx - lx), 9) AS x, round(ly + k / 8e0 * (hy - ly), 9) AS y FROM box, range(9) r(k)")
def default_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nine(S.default_offsets(_box(spark, sf_dir), ("x", "y")), "x", "y")


@query(
    "offsets_along",
    f"WITH {_BOX5}, pr AS (SELECT *, (lx + hx) / 2 AS cx, (ly + hy) / 2 AS cy, 0.6e0 * lx - 0.8e0 * hy AS s0, 0.6e0 * hx - 0.8e0 * ly AS s1 FROM box), "
    "sh AS (SELECT k, cx, cy, s0 + k / 8e0 * (s1 - s0) - (0.6e0 * cx - 0.8e0 * cy) AS s FROM pr, range(9) r(k)) SELECT CAST(k AS INTEGER) AS k, round(cx + s * 0.6e0, 9) AS x, round(cy - s * 0.8e0, 9) AS y FROM sh",
)
def offsets_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets along the direction (3, -4)."""
    return _nine(S.offsets_along(_box(spark, sf_dir), ("x", "y"), (3.0, -4.0)), "x", "y")


PLAN = (
    f"{_BOX5}, {_DIRS}, ln AS (SELECT (p - 1) * 9 + k AS slice, a / CAST(a + b AS DOUBLE) AS dx, b / CAST(a + b AS DOUBLE) AS dy, lx + k / 8e0 * (hx - lx) AS x0, ly + k / 8e0 * (hy - ly) AS y0, "
    "least(a, b) / CAST(a + b AS DOUBLE) * sin(pi() * (k + 0.5e0) / 9) AS w FROM dir, box, range(9) r(k))"
)


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 43 directions at the 9 default offsets; the offsets are parameters and come to the driver."""
    at = [(r["x"], r["y"]) for r in S.default_offsets(_box(spark, sf_dir), ("x", "y")).orderBy("k").collect()]
    return S.collect(S.family(spark, S.default_directions(2, 100, 8), at), 9, "cosine")


@query("collect_slices", f"WITH {PLAN} SELECT slice, round(dx, 9) AS dx, round(dy, 9) AS dy, round(x0, 9) AS x0, round(y0, 9) AS y0, round(w / (SELECT sum(w) FROM ln), 9) AS weight FROM ln")
def collect_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nine(_plan(spark, sf_dir), "dx", "dy", "x0", "y0", "weight")


@query("offset_weights", "SELECT l_suppkey AS slice, CAST(max(l_quantity) - min(l_quantity) AS DOUBLE) AS length, 1e0 AS uniform, 2.5e0 AS scalar FROM lineitem GROUP BY 1")
def offset_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("slice")).agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    weight = lambda spec: S.offset_weight(F.col("lo"), F.col("hi"), spec)
    return ends.select("slice", weight("length").alias("length"), weight("uniform").alias("uniform"), weight(2.5).alias("scalar"))


# Kernels between diagrams of one bar each, whose distances have a closed form: the two bars meet, or both go to the diagonal.
# A supplier's bar runs from the least to the greatest quantity of its returned, or of its other, items.
ONE = (
    "one AS (SELECT l_suppkey AS slice, l_returnflag = 'R' AS side, CAST(min(l_quantity) AS DOUBLE) AS birth, CAST(max(l_quantity) + 1 AS DOUBLE) AS death FROM lineitem GROUP BY ALL), "
    "two AS (SELECT coalesce(a.slice, b.slice) AS slice, greatest(abs(a.birth - b.birth), abs(a.death - b.death)) AS meet, coalesce((a.death - a.birth) / 2, 0) AS ha, coalesce((b.death - b.birth) / 2, 0) AS hb "
    "FROM (SELECT * FROM one WHERE side) a FULL JOIN (SELECT * FROM one WHERE NOT side) b ON a.slice = b.slice), "
    "dist AS (SELECT slice, least(coalesce(meet, 1e300), sqrt(ha * ha + hb * hb)) AS w2, least(coalesce(meet, 1e300), greatest(ha, hb)) AS bn, least(slice + 1, 5) / CAST(slice + 6 AS DOUBLE) AS weight FROM two)"
)


def _one_bar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    item = read(spark, sf_dir, "lineitem")
    one = item.groupBy(F.col("l_suppkey").alias("slice"), (F.col("l_returnflag") == "R").alias("side")).agg(F.min("l_quantity").cast("double").alias("birth"), (F.max("l_quantity") + 1).cast("double").alias("death"), F.lit(1).cast("long").alias("mult"))
    return one.filter("side").drop("side"), one.filter("not side").drop("side")


@query("one_bar_distances", f"WITH {ONE} SELECT slice, round(w2, 6) AS wasserstein, round(bn, 6) AS bottleneck FROM dist")
def one_bar_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _one_bar(spark, sf_dir)
    w = B.slice_distances(a, b, "wasserstein").select("slice", F.round("distance", 6).alias("wasserstein"))
    return w.join(B.slice_distances(a, b, "bottleneck").select("slice", F.round("distance", 6).alias("bottleneck")), "slice")


for _name, _distance, _column, _kind, _form in (
    ("slice_kernel_bottleneck", "bottleneck", "bn", "gaussian", "exp(-d * d / 32e0)"),
    ("slice_kernel_laplacian", "bottleneck", "bn", "laplacian", "exp(-d / 4e0)"),
    ("sliced_wasserstein_kernel", "wasserstein", "w2", "gaussian", "exp(-d * d / 32e0)"),
):

    def _kernel(spark: SparkSession, sf_dir: str, distance: str = _distance, kind: str = _kind) -> DataFrame:
        found = B.slice_distances(*_one_bar(spark, sf_dir), distance)
        return S.slice_kernel(found, slice_weights(spark, sf_dir), kind, 4.0).select(F.round("kernel", 9).alias("kernel"))

    query(_name, f"WITH {ONE}, v AS (SELECT weight, {_column} AS d FROM dist) SELECT round(sum(weight * {_form}) / sum(weight), 9) AS kernel FROM v")(_kernel)


@query("wasserstein_kernel", f"WITH {ONE} SELECT slice, round(exp(-w2 * w2 / 32e0), 9) AS kernel FROM dist")
def wasserstein_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian of the distance of two diagrams, slice by slice."""
    found = B.slice_distances(*_one_bar(spark, sf_dir), "wasserstein")
    return found.select("slice", F.round(B.kernel(F.col("distance"), "gaussian", 4.0), 9).alias("kernel"))


# Filtrations of graphs and drawings


@query(
    "filtration_weight_threshold",
    f"WITH {GRAPH} SELECT 0 AS dim, CAST(pid AS VARCHAR) AS verts, 0e0 AS g1 FROM gv UNION ALL SELECT 1, concat_ws(',', u, v), CAST(n AS DOUBLE) FROM ge "
    "UNION ALL SELECT 2, concat_ws(',', ab.u, ab.v, bc.v), CAST(greatest(ab.n, bc.n, ac.n) AS DOUBLE) FROM ge ab JOIN ge bc ON ab.v = bc.u JOIN ge ac ON ac.u = ab.u AND ac.v = bc.v",
)
def filtration_weight_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = graph(spark, sf_dir)
    return _named(T.build("graph_weight_threshold", v, edges=e, lift="clique", weight="n"))


def _named(cells: DataFrame) -> DataFrame:
    return cells.withColumn("verts", F.array_join(F.transform("verts", lambda p: p.cast("string")), ","))


@query(
    "filtration_function_geodesic",
    f"WITH RECURSIVE {GRAPH}, hop AS (SELECT CAST(0 AS BIGINT) AS pid, 0 AS d UNION SELECT v, d + 1 FROM hop JOIN arcs ON u = pid WHERE d < 25), near AS (SELECT pid, CAST(min(d) AS DOUBLE) AS d FROM hop GROUP BY pid), "
    "val AS (SELECT gv.pid, coalesce(d, (SELECT max(d) + 1 FROM near)) AS g, CAST(gv.pid % 5 AS DOUBLE) AS f FROM gv LEFT JOIN near ON near.pid = gv.pid) "
    "SELECT 0 AS dim, CAST(pid AS VARCHAR) AS verts, g AS g1, f AS g2 FROM val UNION ALL SELECT 1, concat_ws(',', u, v), greatest(a.g, b.g), greatest(a.f, b.f) FROM ge JOIN val a ON a.pid = u JOIN val b ON b.pid = v",
)
def filtration_function_geodesic(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = graph(spark, sf_dir)
    own = v.withColumn("f", F.col("pid") % 5)
    return _named(T.build("graph_function_geodesic", own, edges=e, sources=v.filter("pid = 0"), value="f"))


_SEG = (
    f"{GRAPH}, spot AS (SELECT pid, CAST(pid % 5 AS DOUBLE) AS x, CAST(pid // 5 AS DOUBLE) AS y FROM gv), px AS (SELECT i, j, i * 0.5e0 AS x, j * 0.5e0 AS y FROM range(9) a(i), range(9) b(j)), "
    "sg AS (SELECT a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM ge JOIN spot a ON a.pid = u JOIN spot b ON b.pid = v), "
    "tt AS (SELECT i, j, px.x, px.y, ax, ay, dx, dy, least(greatest((dx * (px.x - ax) + dy * (px.y - ay)) / (dx * dx + dy * dy), 0), 1) AS t FROM px, sg), "
    "ds AS (SELECT i, j, min(sqrt((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2)) AS e FROM tt GROUP BY ALL), dv AS (SELECT i, j, 0e0 - min(sqrt((px.x - spot.x) ** 2 + (px.y - spot.y) ** 2)) AS v FROM px, spot GROUP BY ALL), "
    "im AS (SELECT i, j, v, e FROM ds JOIN dv USING (i, j)), ext AS (SELECT a.di, b.dj FROM range(2) a(di), range(2) b(dj)), "
    "cell AS (SELECT o.di + o.dj AS dim, m.i, m.j, o.di, o.dj, max(n.v) AS g1, max(n.e) AS g2 FROM im m, ext o JOIN im n ON n.i BETWEEN m.i AND m.i + o.di AND n.j BETWEEN m.j AND m.j + o.dj GROUP BY ALL HAVING count(*) = (1 + o.di) * (1 + o.dj))"
)


@query("filtration_wing_vein", f"WITH {_SEG} SELECT CAST(dim AS INTEGER) AS dim, round(g1, 6) AS g1, round(g2, 6) AS g2, count(*) AS n FROM cell GROUP BY ALL")
def filtration_wing_vein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade graph drawn on a 5 x 5 lattice, sampled at half steps; cells counted by their grades."""
    v, e = graph(spark, sf_dir)
    drawn = v.select("pid", (F.col("pid") % 5).alias("x"), F.floor(F.col("pid") / 5).alias("y"))
    cells = T.build("wing_vein", drawn, edges=e, bbox=(0.0, 4.0, 0.0, 4.0), grid=(9, 9))
    return cells.select("dim", *(F.round(c, 6).alias(c) for c in ("g1", "g2"))).groupBy("dim", "g1", "g2").agg(F.count(F.lit(1)).alias("n"))


# Kan extensions along p -> (p + 1) / 2 + 1 from the chain 1..7 to the chain 1..6: nothing maps to 1 and 6.
# On a chain the left one is the space at the last p below q, the right one that at the first p above q.
_TARGET = list(range(1, 7))
ALONG = {p: (p + 1) // 2 + 1 for p in CHAIN}


@query(
    "module_pushforward",
    f"WITH {SPANS}, ts AS (SELECT CAST(q AS BIGINT) AS q FROM range(1, 7) r(q)), ends AS (SELECT t.q, max(CASE WHEN (s.q + 1) // 2 + 1 <= t.q THEN s.q END) AS last, min(CASE WHEN (s.q + 1) // 2 + 1 >= t.q THEN s.q END) AS first FROM ts t, qs s GROUP BY t.q) "
    "SELECT mid, q, CAST(coalesce(last BETWEEN a AND b, false) AS BIGINT) AS left_dim, CAST(coalesce(first BETWEEN a AND b, false) AS BIGINT) AS right_dim FROM sp, ends",
)
def module_pushforward(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = {(a, b) for a in _TARGET for b in _TARGET if a <= b}

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for mid, a, b in pdf[["mid", "a", "b"]].itertuples(index=False):
                m = M.interval(CHAIN, COVERS, set(range(a, b + 1)))
                left, right = M.pushforward_left_dims(m, ALONG, order), M.pushforward_right_dims(m, ALONG, order)
                out += [(mid, q, left[q], right[q]) for q in _TARGET]
            yield pd.DataFrame(out, columns=["mid", "q", "left_dim", "right_dim"])

    return _spans(spark, sf_dir).mapInPandas(run, "mid long, q long, left_dim long, right_dim long")


@query("product_poset", "WITH a AS (SELECT DISTINCT CAST(n_regionkey AS BIGINT) AS p FROM nation), c1 AS (SELECT x.p AS u, y.p AS v FROM a x JOIN a y ON y.p = x.p + 1), b AS (SELECT CAST(p AS BIGINT) AS p FROM range(1, 8) r(p)), c2 AS (SELECT x.p AS u, y.p AS v FROM b x JOIN b y ON y.p = x.p + 1) SELECT c1.u, b.p AS u2, c1.v, b.p AS v2 FROM c1, b UNION ALL SELECT a.p, c2.u, a.p, c2.v FROM a, c2")
def product_poset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covers of the product of the regions' chain and the chain 1..7."""
    a = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("p"))
    c1 = a.select(F.col("p").alias("u"), (F.col("p") + 1).alias("v")).join(a.select(F.col("p").alias("v")), "v", "left_semi").select("u", "v")
    b = spark.createDataFrame([(p,) for p in CHAIN], "p long")
    return M.product_covers(c1, spark.createDataFrame(COVERS, "u long, v long"), a, b)
