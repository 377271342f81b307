"""Queries on two-parameter homology of a graph, on centralities and on families of small modules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import linalg
from ..operators import bipersistence as P
from ..operators import centrality as C
from ..operators import modules as M
from .registry import query
from .tables import GRAPH, graph, read

NX, NY = 5, 4


def _graded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The trade graph: nations by (region, key modulo 3), an edge at its ends' join, odd ones a step higher."""
    v = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("pid"), (F.col("n_regionkey") + 1).cast("int").alias("x"), (F.col("n_nationkey") % 3 + 1).cast("int").alias("y"))
    e = graph(spark, sf_dir)[1].select("u", "v")
    for c in "uv":
        e = e.join(v.select(F.col("pid").alias(c), F.col("x").alias(f"x{c}"), F.col("y").alias(f"y{c}")), c)
    return v, e.select("u", "v", F.greatest("xu", "xv").alias("x"), (F.greatest("yu", "yv") + (F.col("u") + F.col("v")) % 2).cast("int").alias("y"))


GRADED = (
    f"{GRAPH}, vx AS (SELECT CAST(n_nationkey AS BIGINT) AS pid, CAST(n_regionkey + 1 AS INTEGER) AS x, CAST(n_nationkey % 3 + 1 AS INTEGER) AS y FROM nation), "
    "ex AS (SELECT u, v, greatest(a.x, b.x) AS x, CAST(greatest(a.y, b.y) + (u + v) % 2 AS INTEGER) AS y FROM ge JOIN vx a ON a.pid = u JOIN vx b ON b.pid = v), "
    f"grid AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM range(1, {NX + 1}) a(i), range(1, {NY + 1}) b(j)), la AS (SELECT i, j, u, v FROM grid JOIN ex ON x <= i AND y <= j), lb AS (SELECT i, j, u, v FROM la UNION ALL SELECT i, j, v, u FROM la), "
    "walk AS (SELECT i, j, pid AS a, pid AS b FROM grid JOIN vx ON x <= i AND y <= j UNION SELECT walk.i, walk.j, walk.a, lb.v FROM walk JOIN lb ON lb.i = walk.i AND lb.j = walk.j AND lb.u = walk.b), "
    "comp AS (SELECT i, j, a AS pid, min(b) AS root FROM walk GROUP BY i, j, a)"
)
RANK2 = f"{GRADED}, rk AS (SELECT p.i AS pi, p.j AS pj, q.i AS qi, q.j AS qj, count(DISTINCT root) AS rank FROM grid p JOIN comp q ON p.i <= q.i AND p.j <= q.j JOIN vx ON vx.pid = q.pid AND vx.x <= p.i AND vx.y <= p.j GROUP BY ALL)"


def _h0(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v, e = _graded(spark, sf_dir)
    return P.h0_components(v, e, NX, NY), v


def _rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.h0_rank(*_h0(spark, sf_dir))


@query("h0_hilbert", f"WITH RECURSIVE {GRADED} SELECT i, j, count(DISTINCT root) AS dim FROM comp GROUP BY i, j")
def h0_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.h0_hilbert(_h0(spark, sf_dir)[0])


@query("h0_rank_invariant", f"WITH RECURSIVE {RANK2} SELECT pi, pj, qi, qj, rank FROM rk")
def h0_rank_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank(spark, sf_dir)


W2 = f"{RANK2}, sh AS (SELECT pi + a AS pi, pj + b AS pj, qi - c AS qi, qj - d AS qj, CASE WHEN (a + b + c + d) % 2 = 0 THEN rank ELSE -rank END AS w FROM rk, range(2) s1(a), range(2) s2(b), range(2) s3(c), range(2) s4(d)), rect AS (SELECT CAST(pi AS INTEGER) AS pi, CAST(pj AS INTEGER) AS pj, CAST(qi AS INTEGER) AS qi, CAST(qj AS INTEGER) AS qj, CAST(sum(w) AS BIGINT) AS w FROM sh WHERE pi <= qi AND pj <= qj GROUP BY 1, 2, 3, 4 HAVING sum(w) <> 0)"


@query("rectangle_signed_barcode", f"WITH RECURSIVE {W2} SELECT * FROM rect")
def rectangle_signed_barcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rectangles(_rank(spark, sf_dir))


@query("rank_from_signed_barcode", f"WITH RECURSIVE {RANK2} SELECT pi, pj, qi, qj, rank FROM rk")
def rank_from_signed_barcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rank_of_rectangles(P.rectangles(_rank(spark, sf_dir))).withColumn("rank", F.col("rank").cast("long"))


@query("rectangle_barcode_kernel", f"WITH RECURSIVE {W2} SELECT round(sum(a.w * b.w * exp(-((a.pi - b.pi) ** 2 + (a.pj - b.pj) ** 2 + (a.qi - b.qi) ** 2 + (a.qj - b.qj) ** 2) / 8e0)), 6) AS kernel FROM rect a, rect b")
def rectangle_barcode_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.rectangles(_rank(spark, sf_dir))
    return P.rectangle_kernel(r, r, 2.0).select(F.round("kernel", 6).alias("kernel"))


# Three monotone chains through the grid, as (i, j) from the bottom to the top.
CHAINS = {0: [(1, 1), (2, 2), (3, 3), (4, 4), (5, 4)], 1: [(1, 1), (1, 2), (1, 3), (1, 4), (2, 4), (5, 4)], 2: [(1, 3), (2, 3), (3, 3), (4, 3), (5, 3), (5, 4)]}
_PLACES = [(s, k + 1, i, j) for s, c in CHAINS.items() for k, (i, j) in enumerate(c)]
SLICED = f"{RANK2}, ch(slice, pos, i, j) AS (VALUES {', '.join(map(str, _PLACES))}), al AS (SELECT a.slice, a.pos AS p, b.pos AS q, coalesce(rank, 0) AS r FROM ch a JOIN ch b ON a.slice = b.slice AND a.pos <= b.pos LEFT JOIN rk ON pi = a.i AND pj = a.j AND qi = b.i AND qj = b.j)"


def _chains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_PLACES, "slice int, pos int, i int, j int")


@query("restricted_rank", f"WITH RECURSIVE {SLICED} SELECT slice, p, q, r AS rank FROM al")
def restricted_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank invariant restricted to chains."""
    return P.along(_rank(spark, sf_dir), _chains(spark))


@query(
    "slice_barcodes",
    f"WITH RECURSIVE {SLICED} SELECT x.slice, x.p AS birth, x.q + 1 AS death, x.r - coalesce(a.r, 0) - coalesce(b.r, 0) + coalesce(c.r, 0) AS mult FROM al x LEFT JOIN al a ON a.slice = x.slice AND a.p = x.p - 1 AND a.q = x.q LEFT JOIN al b ON b.slice = x.slice AND b.p = x.p AND b.q = x.q + 1 "
    "LEFT JOIN al c ON c.slice = x.slice AND c.p = x.p - 1 AND c.q = x.q + 1 WHERE x.r - coalesce(a.r, 0) - coalesce(b.r, 0) + coalesce(c.r, 0) <> 0",
)
def slice_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.slice_bars(restricted_rank(spark, sf_dir))


def _complex(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v, e = _graded(spark, sf_dir)
    e = e.withColumn("cid", 1000 + F.col("u") * 100 + F.col("v"))
    cells = v.select(F.col("pid").alias("cid"), F.lit(0).alias("dim"), "x", "y").unionByName(e.select("cid", F.lit(1).alias("dim"), "x", "y"))
    faces = e.select("cid", F.col("u").alias("face"), F.lit(-1).alias("coeff")).unionByName(e.select("cid", F.col("v").alias("face"), F.lit(1).alias("coeff")))
    return cells, faces


@query("cochain_complex", f"WITH {GRADED.split(', grid AS')[0]} SELECT 0 AS dim, u AS face, 1000 + u * 100 + v AS cid, -1 AS coeff FROM ex UNION ALL SELECT 0, v, 1000 + u * 100 + v, 1 FROM ex")
def cochain_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cochains(*_complex(spark, sf_dir))


# Of a graph: H0 counts components, H1 is what the Euler characteristic leaves.
HOMOLOGY = f"WITH RECURSIVE {GRADED}, c AS (SELECT i, j, count(DISTINCT root) AS h0, count(*) AS nv FROM comp GROUP BY i, j), m AS (SELECT i, j, count(*) AS ne FROM la GROUP BY i, j) SELECT c.i, c.j, 0 AS degree, CAST(h0 AS INTEGER) AS dim FROM c UNION ALL SELECT c.i, c.j, 1, CAST(ne - nv + h0 AS INTEGER) FROM c JOIN m ON m.i = c.i AND m.j = c.j"


@query("homology_dims", HOMOLOGY)
def homology_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.homology_dims(*_complex(spark, sf_dir), NX, NY)


@query("homology_dims_mod2", HOMOLOGY)
def homology_dims_mod2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.homology_dims(*_complex(spark, sf_dir), NX, NY, 2)


WALKS = f"{GRAPH}, hop AS (SELECT pid AS s, pid AS t, 0 AS d FROM gv UNION SELECT hop.s, arcs.v, hop.d + 1 FROM hop JOIN arcs ON arcs.u = hop.t WHERE hop.d < 25), dist AS (SELECT s, t, min(d) AS d FROM hop GROUP BY s, t)"


@query("graph_closeness", f"WITH RECURSIVE {WALKS} SELECT s AS pid, round(CASE WHEN sum(d) > 0 THEN (count(*) - 1) / CAST(sum(d) AS DOUBLE) ELSE 0 END, 9) AS value FROM dist GROUP BY s")
def graph_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.closeness(*graph(spark, sf_dir)).withColumn("value", F.round("value", 9))


@query(
    "graph_betweenness",
    f"WITH RECURSIVE {WALKS}, path AS (SELECT pid AS s, pid AS t, 0 AS d FROM gv UNION ALL SELECT path.s, arcs.v, path.d + 1 FROM path JOIN arcs ON arcs.u = path.t JOIN dist ON dist.s = path.s AND dist.t = arcs.v AND dist.d = path.d + 1), "
    "np AS (SELECT s, t, d, CAST(count(*) AS DOUBLE) AS n FROM path GROUP BY s, t, d) SELECT gv.pid, round(coalesce((SELECT sum(a.n * b.n / c.n) / 2 FROM np a JOIN np b ON a.t = b.s JOIN np c ON c.s = a.s AND c.t = b.t WHERE a.t = gv.pid AND a.s <> gv.pid AND b.t <> gv.pid AND a.d + b.d = c.d), 0), 6) AS value FROM gv",
)
def graph_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.betweenness(*graph(spark, sf_dir)).withColumn("value", F.round("value", 6))


# ---- one pair of interval modules for each nation, on a chain of 7, with the identity on their overlap ----

CHAIN = list(range(1, 8))
COVERS = list(zip(CHAIN, CHAIN[1:], strict=False))
SPANS = "sp AS (SELECT k AS mid, k % 3 + 1 AS c, k % 3 + 1 + k % 2 AS a, k % 3 + 1 + k % 2 + k % 3 AS d, k % 3 + 1 + k % 2 + k % 3 + (k // 2) % 2 AS b FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation)), qs AS (SELECT CAST(q AS BIGINT) AS q FROM range(1, 8) r(q)), al AS (SELECT mid, q, CAST(q BETWEEN a AND b AS INTEGER) AS m, CAST(q BETWEEN c AND d AS INTEGER) AS n, CAST(q BETWEEN a AND d AS INTEGER) AS r FROM sp, qs)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mid, a, b, c, d``: the source lives on [a, b], the target on [c, d], with c <= a <= d <= b."""
    k = F.col("n_nationkey").cast("long")
    c, odd = k % 3 + 1, k % 2
    return read(spark, sf_dir, "nation").select(k.alias("mid"), (c + odd).alias("a"), (c + odd + k % 3 + F.floor(k / 2) % 2).alias("b"), c.alias("c"), (c + odd + k % 3).alias("d"))


def _each(spark: SparkSession, sf_dir: str, columns: list[str], f) -> DataFrame:
    """``mid, q`` and ``columns`` from ``f`` of (source, target, morphism), one pair of modules at a time."""

    def run(batches):
        for pdf in batches:
            out = []
            for mid, a, b, c, d in pdf[["mid", "a", "b", "c", "d"]].itertuples(index=False):
                m = M.interval(CHAIN, COVERS, set(range(a, b + 1)))
                n = M.interval(CHAIN, COVERS, set(range(c, d + 1)))
                g = {v: [[int(a <= v <= d)] * m.dims[v] for _ in range(n.dims[v])] for v in CHAIN}
                out += [(mid, *row) for row in f(m, n, g)]
            yield pd.DataFrame(out, columns=["mid", "q", *columns]).astype("int64")

    return _spans(spark, sf_dir).mapInPandas(run, "mid long, q long, " + ", ".join(f"{c} long" for c in columns))


def _dims(*mods: M.Module) -> list[tuple]:
    return [(v, *(x.dims[v] for x in mods)) for v in CHAIN]


@query("morphism_dims", f"WITH {SPANS} SELECT mid, q, CAST(m - r AS BIGINT) AS kernel, CAST(r AS BIGINT) AS image, CAST(n - r AS BIGINT) AS cokernel FROM al")
def morphism_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, ["kernel", "image", "cokernel"], lambda m, n, g: M.morphism_dims(m, n, g).itertuples(index=False, name=None))


@query("abelian_objects", f"WITH {SPANS} SELECT mid, q, CAST(m - r AS BIGINT) AS kernel, CAST(r AS BIGINT) AS image, CAST(n - r AS BIGINT) AS cokernel, CAST(r AS BIGINT) AS coimage, CAST(m + n AS BIGINT) AS biproduct FROM al")
def abelian_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects as modules with their structure maps, whose shapes are checked when they are built."""

    def f(m, n, g):
        kernel, into = M.kernel_with_inclusion(m, n, g)
        image, _ = M.image_with_inclusion(m, n, g)
        cokernel, _ = M.cokernel_with_projection(m, n, g)
        coimage, _ = M.cokernel_with_projection(kernel, m, into)
        return _dims(kernel, image, cokernel, coimage, M.direct_sum(m, n))

    return _each(spark, sf_dir, ["kernel", "image", "cokernel", "coimage", "biproduct"], f)


@query("abelian_limits", f"WITH {SPANS} SELECT mid, q, CAST(2 * m - r AS BIGINT) AS pullback, CAST(2 * n - r AS BIGINT) AS pushout, CAST(m AS BIGINT) AS equal, CAST(m - r AS BIGINT) AS equal_zero, CAST(n AS BIGINT) AS coequal, CAST(n - r AS BIGINT) AS coequal_zero FROM al")
def abelian_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pullback and pushout of the morphism with itself, (co)equalizers of it with itself and with zero."""

    def f(m, n, g):
        zero = {v: [[0] * m.dims[v] for _ in range(n.dims[v])] for v in CHAIN}
        return _dims(M.pullback(m, m, n, g, g)[0], M.pushout(m, n, n, g, g)[0], M.equalizer(m, n, g, g)[0], M.equalizer(m, n, g, zero)[0], M.coequalizer(m, n, g, g)[0], M.coequalizer(m, n, g, zero)[0])

    return _each(spark, sf_dir, ["pullback", "pushout", "equal", "equal_zero", "coequal", "coequal_zero"], f)


@query("module_limits", f"WITH {SPANS} SELECT mid, CAST(0 AS BIGINT) AS q, CAST(a = 1 AS BIGINT) AS limit_dim, CAST(b = 7 AS BIGINT) AS colimit_dim FROM sp")
def module_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a chain the limit is the first vertex's space and the colimit the last one's."""
    return _each(spark, sf_dir, ["limit_dim", "colimit_dim"], lambda m, n, g: [(0, M.limit_dimension(m), M.colimit_dimension(m))])


@query("module_betti_bass", f"WITH {SPANS} SELECT mid, q, CAST(q = a AS BIGINT) AS betti, CAST(q = b AS BIGINT) AS bass FROM sp, qs")
def module_betti_bass(spark: SparkSession, sf_dir: str) -> DataFrame:
    def f(m, n, g):
        up, down = m.generators(), m.cogenerators()
        return [(v, up[v], down[v]) for v in CHAIN]

    return _each(spark, sf_dir, ["betti", "bass"], f)


@query("module_rank_map", f"WITH {SPANS} SELECT mid, x.q AS q, y.q AS p2, CAST((x.q BETWEEN a AND b AND y.q BETWEEN a AND b) AS INTEGER) + CAST((x.q BETWEEN c AND d AND y.q BETWEEN c AND d) AS INTEGER) AS rank FROM sp, qs x, qs y WHERE x.q <= y.q".replace("AS rank FROM", "AS rank FROM"))
def module_rank_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of all structure maps of the direct sum of each pair."""

    def f(m, n, g):
        both = M.direct_sum(m, n)
        return [(p, q, both.rank_map(p, q)) for p in CHAIN for q in CHAIN if p <= q]

    return _each(spark, sf_dir, ["p2", "rank"], f).withColumn("rank", F.col("rank").cast("int"))


HOMS = f"{SPANS}, h AS (SELECT x.mid, y.mid AS q, CAST(y.a <= x.a AND x.a <= y.b AND y.b <= x.b AS BIGINT) AS hom FROM sp x, sp y), f AS (SELECT x.mid, y.mid AS q, sum(x.m * y.m) - sum(CASE WHEN x.q < 7 THEN x.m * z.m ELSE 0 END) AS form FROM al x JOIN al y ON x.q = y.q LEFT JOIN al z ON z.mid = y.mid AND z.q = x.q + 1 GROUP BY x.mid, y.mid)"


@query("module_hom_ext", f"WITH {HOMS} SELECT h.mid, h.q, hom, CAST(hom - form AS BIGINT) AS ext1 FROM h JOIN f ON f.mid = h.mid AND f.q = h.q")
def module_hom_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hom and Ext^1 of all pairs of source modules; the pairs are all of a small table of modules."""
    ends = _spans(spark, sf_dir).select("mid", "a", "b")
    pairs = ends.crossJoin(F.broadcast(ends.select(F.col("mid").alias("q"), F.col("a").alias("c"), F.col("b").alias("d"))))  # 25 nations

    def run(batches):
        for pdf in batches:
            out = []
            for mid, a, b, q, c, d in pdf[["mid", "a", "b", "q", "c", "d"]].itertuples(index=False):
                m, n = M.interval(CHAIN, COVERS, set(range(a, b + 1))), M.interval(CHAIN, COVERS, set(range(c, d + 1)))
                out.append((mid, q, M.hom_dimension(m, n), M.ext1_dimension_chain(m, n, CHAIN)))
            yield pd.DataFrame(out, columns=["mid", "q", "hom", "ext1"]).astype("int64")

    return pairs.mapInPandas(run, "mid long, q long, hom long, ext1 long")


@query("module_restriction", f"WITH {SPANS} SELECT mid, q, CAST(2 * q - 1 BETWEEN a AND b AS BIGINT) AS dim FROM sp, qs WHERE q <= 4")
def module_restriction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulled back along the odd vertices of the chain."""
    odd = {q: 2 * q - 1 for q in range(1, 5)}
    return _each(spark, sf_dir, ["dim"], lambda m, n, g: sorted(M.restriction(m, odd, [(1, 2), (2, 3), (3, 4)]).dims.items()))


# ---- exact linear algebra inside one group ----


def _one_group(df: DataFrame, f, schema: str) -> DataFrame:
    """``f`` of a small table's rows as one matrix."""
    return df.groupBy(F.lit(0).alias("g")).applyInPandas(lambda pdf: f(pdf), schema)


INCIDENCE = f"WITH RECURSIVE {WALKS}, n AS (SELECT (SELECT count(*) FROM gv) AS nv, (SELECT count(*) FROM ge) AS ne, (SELECT count(DISTINCT r) FROM (SELECT min(t) AS r FROM dist GROUP BY s)) AS nc)"


@query("incidence_rank", f"{INCIDENCE} SELECT field, CAST(nv - nc AS BIGINT) AS rank, CAST(ne - nv + nc AS BIGINT) AS nullity, CAST(nv - nc AS BIGINT) AS basis FROM n, (VALUES ('rational'), ('2'), ('3'), ('real')) f(field)")
def incidence_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank, nullity and a column basis' size of the trade graph's incidence matrix over four fields."""
    edges = graph(spark, sf_dir)[1].select("u", "v")

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = sorted(zip(pdf["u"], pdf["v"], strict=True))
        ids = sorted({x for p in pairs for x in p})
        m = [[(v == b) - (v == a) for a, b in pairs] for v in ids]
        out = []
        for name, field in (("rational", None), ("2", 2), ("3", 3), ("real", "real")):
            out.append((name, linalg.rank(m, field), len(linalg.nullspace(m, len(pairs), field)), len(linalg.colspace(m, field))))
        return pd.DataFrame(out, columns=["field", "rank", "nullity", "basis"])

    return _one_group(edges, f, "field string, rank long, nullity long, basis long")


COUNTS = "cn AS (SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) AS r, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("long").alias("r"))
    c = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(c, "k", "left").select("k", "r", F.coalesce("n", F.lit(0)).alias("n"))


@query("triangular_solve", f"WITH {COUNTS} SELECT k, n AS solved, n AS reduced FROM cn")
def triangular_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums of customers by nation, solved back to the counts, by the solver and by row reduction."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        size = len(pdf)
        lower = [[int(j <= i) for j in range(size)] for i in range(size)]
        sums = [[int(x)] for x in pdf["n"].cumsum()]
        x = linalg.solve(lower, sums)
        reduced, _ = linalg.rref([a + b for a, b in zip(lower, sums, strict=True)])
        return pd.DataFrame({"k": pdf["k"].to_numpy(), "solved": [int(v[0]) for v in x], "reduced": [int(v[-1]) for v in reduced]})

    return _one_group(_counts(spark, sf_dir), f, "k long, solved long, reduced long")


@query("restricted_matrix_rank", f"WITH {COUNTS} SELECT r, count(*) AS rank, CAST(0 AS BIGINT) AS nullity FROM cn GROUP BY r")
def restricted_matrix_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triangular matrix on each region's rows and columns."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        size = int(pdf["k"].max()) + 1
        lower = [[int(j <= i) for j in range(size)] for i in range(size)]
        out = []
        for r, own in pdf.groupby("r"):
            at = sorted(int(k) for k in own["k"])
            part = linalg.restricted(lower, at, at)
            out.append((r, linalg.rank(part), len(linalg.nullspace(part, len(at)))))
        return pd.DataFrame(out, columns=["r", "rank", "nullity"])

    return _one_group(_counts(spark, sf_dir), f, "r long, rank long, nullity long")
