"""Two-parameter homology of graded complexes over a grid of grades.

Grades are axis positions from 1. ``h0_*`` work on graphs of any size: every grade's graph is a layer of one graph, and
components of all layers are found together. ``homology_dims`` takes ranks inside one group for each grade, for small
complexes. A rank invariant is a table ``pi, pj, qi, qj, rank`` with p <= q.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg
from ..functions.store import cut
from . import graphs as G


def layers(cells: DataFrame, nx: int, ny: int) -> DataFrame:
    """``cells`` (with their grade ``x, y``) once for each grade ``i, j`` of the grid at or above it."""
    across = cells.withColumn("i", F.explode(F.sequence(F.col("x").cast("int"), F.lit(nx))))
    return across.withColumn("j", F.explode(F.sequence(F.col("y").cast("int"), F.lit(ny))))


def h0_components(vertices: DataFrame, edges: DataFrame, nx: int, ny: int) -> DataFrame:
    """``i, j, pid, root``: components of the sublevel graph at every grade. ``vertices``: pid >= 0, x, y; ``edges``: u, v, x, y."""
    stride = (vertices.agg(F.max("pid")).first()[0] or 0) + 1
    code = lambda c: ((F.col("i") - 1) * ny + F.col("j") - 1).cast("long") * stride + F.col(c)
    v = layers(vertices, nx, ny).select(code("pid").alias("pid"))
    e = layers(edges, nx, ny).select(code("u").alias("u"), code("v").alias("v"))
    found = G.components(v, e)
    layer = F.floor(F.col("pid") / stride)
    return found.select((F.floor(layer / ny) + 1).cast("int").alias("i"), (layer % ny + 1).cast("int").alias("j"), (F.col("pid") % stride).alias("pid"), (F.col("root") % stride).alias("root"))


def h0_hilbert(found: DataFrame) -> DataFrame:
    """``i, j, dim`` from ``h0_components``; grades without a vertex have no row."""
    return found.groupBy("i", "j").agg(F.count_distinct("root").alias("dim"))


def h0_rank(found: DataFrame, vertices: DataFrame) -> DataFrame:
    """The rank invariant of H0: components at q that hold a vertex alive at p. Zeros have no row."""
    born = found.join(vertices.select("pid", "x", "y"), "pid").select(F.col("i").alias("qi"), F.col("j").alias("qj"), "root", "x", "y").distinct()
    at = born.withColumn("pi", F.explode(F.sequence(F.col("x").cast("int"), "qi"))).withColumn("pj", F.explode(F.sequence(F.col("y").cast("int"), "qj")))
    return at.select("pi", "pj", "qi", "qj", "root").distinct().groupBy("pi", "pj", "qi", "qj").agg(F.count(F.lit(1)).alias("rank"))


def rectangles(rank: DataFrame) -> DataFrame:
    """``pi, pj, qi, qj, w``: the signed rectangles [p, q] whose sum is the rank invariant (Moebius inversion)."""
    signs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.lit(d).alias("d"), F.lit((-1) ** (a + b + c + d)).alias("s")) for a in (0, 1) for b in (0, 1) for c in (0, 1) for d in (0, 1)))
    rows = rank.withColumn("e", F.explode(signs))
    moved = rows.select((F.col("pi") + F.col("e.a")).alias("pi"), (F.col("pj") + F.col("e.b")).alias("pj"), (F.col("qi") - F.col("e.c")).alias("qi"), (F.col("qj") - F.col("e.d")).alias("qj"), (F.col("e.s") * F.col("rank")).alias("w"))
    return moved.filter("pi <= qi and pj <= qj").groupBy("pi", "pj", "qi", "qj").agg(F.sum("w").alias("w")).filter("w <> 0")


def rank_of_rectangles(found: DataFrame) -> DataFrame:
    """The rank invariant that signed rectangles add up to; zeros have no row."""
    rows = found.select(*(F.col(c).alias(f"r_{c}") for c in ("pi", "pj", "qi", "qj")), "w")
    for low, high, c in (("r_pi", "r_qi", "pi"), ("r_pj", "r_qj", "pj")):
        rows = rows.withColumn(c, F.explode(F.sequence(low, high)))
    for low, high, c in (("pi", "r_qi", "qi"), ("pj", "r_qj", "qj")):
        rows = rows.withColumn(c, F.explode(F.sequence(low, high)))
    return rows.groupBy("pi", "pj", "qi", "qj").agg(F.sum("w").alias("rank")).filter("rank <> 0")


def rectangle_kernel(a: DataFrame, b: DataFrame, sigma: float) -> DataFrame:
    """Gaussian kernel of two signed rectangle barcodes, as points of four coordinates; barcodes are small tables."""
    names = ("pi", "pj", "qi", "qj")
    x = a.select(*(F.col(c).alias(f"a_{c}") for c in names), F.col("w").alias("a_w"), F.lit(0).alias("k"))
    y = b.select(*(F.col(c).alias(f"b_{c}") for c in names), F.col("w").alias("b_w"), F.lit(0).alias("k"))
    d = sum((F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), 2) for c in names), F.lit(0.0))
    return x.join(F.broadcast(y) if y.count() <= 100_000 else y, "k").agg(F.sum(F.col("a_w") * F.col("b_w") * F.exp(-d / (2 * sigma * sigma))).alias("kernel"))


def along(rank: DataFrame, chain: DataFrame) -> DataFrame:
    """``slice, p, q, rank``: a rank invariant along chains of grades (``slice, pos, i, j``)."""
    p = chain.select("slice", F.col("pos").alias("p"), F.col("i").alias("pi"), F.col("j").alias("pj"))
    q = chain.select("slice", F.col("pos").alias("q"), F.col("i").alias("qi"), F.col("j").alias("qj"))
    both = p.join(q, "slice").filter("p <= q")
    return both.join(rank, ["pi", "pj", "qi", "qj"], "left").select("slice", "p", "q", F.coalesce("rank", F.lit(0)).alias("rank"))


def slice_bars(ranks: DataFrame) -> DataFrame:
    """``slice, birth, death, mult`` from ranks along chains; a bar alive at the chain's last place dies one after it."""
    by_q, by_p = Window.partitionBy("slice", "q").orderBy("p"), Window.partitionBy("slice", "p").orderBy("q")
    once = ranks.withColumn("r", F.col("rank") - F.coalesce(F.lag("rank").over(by_q), F.lit(0)))
    mult = F.col("r") - F.coalesce(F.lead("r").over(by_p), F.lit(0))
    return once.select("slice", F.col("p").alias("birth"), (F.col("q") + 1).alias("death"), mult.alias("mult")).filter("mult <> 0")


def cochains(cells: DataFrame, boundary: DataFrame) -> DataFrame:
    """``dim, face, cid, coeff``: the coboundary from cells of ``dim`` to those above. ``boundary``: cid, face, coeff."""
    return boundary.join(cells.select("cid", (F.col("dim") - 1).alias("dim")), "cid").select("dim", "face", "cid", "coeff")


def homology_dims(cells: DataFrame, boundary: DataFrame, nx: int, ny: int, field: int | str | None = None) -> DataFrame:
    """``i, j, degree, dim``: homology at every grade. ``cells``: cid, dim, x, y; ``boundary``: cid, face, coeff."""
    rows = boundary.groupBy("cid").agg(F.collect_list(F.struct("face", "coeff")).alias("faces"))  # a cell's own faces
    at = cut(layers(cells.join(rows, "cid", "left"), nx, ny))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        by_dim = {d: list(g["cid"]) for d, g in pdf.groupby("dim")}
        faces = dict(zip(pdf["cid"], pdf["faces"], strict=True))
        ranks = {}
        for d, cids in by_dim.items():
            below = {c: k for k, c in enumerate(by_dim.get(d - 1, []))}
            m = [[0] * len(below) for _ in cids]
            for k, c in enumerate(cids):
                for f in faces[c] if faces[c] is not None else ():
                    m[k][below[f["face"]]] = int(f["coeff"])
            ranks[d] = linalg.rank(m, field) if below else 0
        top = max(by_dim)
        out = [(key[0], key[1], d, len(by_dim.get(d, [])) - ranks.get(d, 0) - ranks.get(d + 1, 0)) for d in range(top + 1)]
        return pd.DataFrame(out, columns=["i", "j", "degree", "dim"])

    return at.groupBy("i", "j").applyInPandas(run, "i int, j int, degree int, dim int")
