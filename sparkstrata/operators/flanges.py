"""Flanges: presentations over a lattice by a matrix from upsets (flats) to downsets (injectives).

``gens``: gen, kind ('up' or 'down'), lo_x, lo_y, hi_x, hi_y, integer bounds, null for a free direction. ``phi``: down,
up, num, den. An entry of phi counts at the points of the box between its upset's and its downset's corner, so the
matrices of all points are one expansion of entries clipped to a window: generators and points are never joined.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linalg import rank
from ..functions.store import cut

BOUNDS = ("lo_x", "lo_y", "hi_x", "hi_y")
Corner = tuple[int, int]


def entries(gens: DataFrame, phi: DataFrame) -> DataFrame:
    """``down, up, num, den`` with the bounds of the box where the entry counts; entries that are 0 are left out."""
    up = gens.filter("kind = 'up'").select(F.col("gen").alias("up"), "lo_x", "lo_y")
    down = gens.filter("kind = 'down'").select(F.col("gen").alias("down"), "hi_x", "hi_y")
    return phi.filter("num <> 0").join(up, "up").join(down, "down").select("down", "up", "num", "den", *BOUNDS)


def matrices_on_box(gens: DataFrame, phi: DataFrame, a: Corner, b: Corner, step: Corner = (0, 0)) -> DataFrame:
    """``x, y, down, up, num, den``: for every g of the window [a, b], entries of upsets that hold g and downsets that hold g + step."""
    rows = entries(gens, phi)
    for k, axis in enumerate("xy"):
        low = F.greatest(F.lit(a[k]).cast("long"), F.coalesce(F.ceil(f"lo_{axis}"), F.lit(a[k])).cast("long"))
        high = F.least(F.lit(b[k]).cast("long"), F.coalesce(F.floor(f"hi_{axis}") - step[k], F.lit(b[k])).cast("long"))
        rows = rows.withColumn("_lo", low).withColumn("_hi", high).filter("_lo <= _hi").withColumn(axis, F.explode(F.sequence("_lo", "_hi")))
    return rows.select("x", "y", "down", "up", "num", "den")


def degree_matrix(gens: DataFrame, phi: DataFrame, points: DataFrame) -> DataFrame:
    """``x, y, down, up, num, den``: the matrix at each of the given lattice points (``x, y``); points without entries have no row."""
    ends = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if ends[0] is None:
        return matrices_on_box(gens, phi, (0, 0), (-1, -1))
    inside = matrices_on_box(gens, phi, (int(ends[0]), int(ends[1])), (int(ends[2]), int(ends[3])))
    return inside.join(points.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct(), ["x", "y"], "left_semi")


def ranks(matrices: DataFrame, field: int | str | None = None) -> DataFrame:
    """``x, y, step, rank`` of each matrix (``x, y, step`` and entries); one group a matrix, whose size is that of the presentation there."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {d: k for k, d in enumerate(sorted(set(pdf["down"])))}
        cols = {u: k for k, u in enumerate(sorted(set(pdf["up"])))}
        m = [[0] * len(cols) for _ in rows]
        for d, u, n, e in zip(pdf["down"], pdf["up"], pdf["num"], pdf["den"], strict=True):
            m[rows[d]][cols[u]] = Fraction(int(n), int(e))
        return pd.DataFrame([(*key, rank(m, field))], columns=["x", "y", "step", "rank"])

    return matrices.groupBy("x", "y", "step").applyInPandas(run, "x long, y long, step string, rank long")


def module_on_box(spark: SparkSession, gens: DataFrame, phi: DataFrame, a: Corner, b: Corner, field: int | str | None = None) -> DataFrame:
    """``x, y, dim, rank_x, rank_y``: the module on the window, its fibres' dimensions and the ranks of the maps one step up.

    A fibre is the image of its matrix. Maps that leave the window are null.
    """
    wide, high = b[0] - a[0] + 1, b[1] - a[1] + 1
    grid = spark.range(wide * high).select((F.floor(F.col("id") / high) + a[0]).cast("long").alias("x"), (F.col("id") % high + a[1]).cast("long").alias("y"))
    steps = {"dim": (0, 0), "rank_x": (1, 0), "rank_y": (0, 1)}
    parts = [matrices_on_box(gens, phi, a, b, step).withColumn("step", F.lit(name)) for name, step in steps.items()]
    found = ranks(parts[0].unionByName(parts[1]).unionByName(parts[2]), field)
    held = found.groupBy("x", "y").agg(*(F.max(F.when(F.col("step") == name, F.col("rank"))).alias(name) for name in steps))
    grid = grid.join(held, ["x", "y"], "left").select("x", "y", *(F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in steps))
    return grid.withColumn("rank_x", F.when(F.col("x") < b[0], F.col("rank_x"))).withColumn("rank_y", F.when(F.col("y") < b[1], F.col("rank_y")))


def _repeated(gens: DataFrame, phi: DataFrame, kind: str) -> DataFrame:
    """``gen``: generators of a kind that are multiples of the first one with the same bounds, or zero."""
    side, other = ("up", "down") if kind == "up" else ("down", "up")
    vectors = phi.filter("num <> 0").groupBy(F.col(side).alias("gen")).agg(F.array_sort(F.collect_list(F.struct(F.col(other).alias("at"), "num", "den"))).alias("vec"))
    own = gens.filter(F.col("kind") == kind).join(vectors, "gen", "left").withColumn("vec", F.coalesce("vec", F.array().cast(vectors.schema["vec"].dataType)))
    first = own.groupBy(*(F.col(c).alias(f"f_{c}") for c in BOUNDS)).agg(F.min_by(F.struct("gen", "vec"), "gen").alias("f"))
    both = own.join(first, [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in BOUNDS]).filter("gen <> f.gen")
    wide = lambda c: c.cast("decimal(38,0)")
    v, w = F.element_at("f.vec", 1), F.element_at("vec", 1)
    # e / w = g / v for all places: products of four whole numbers, in decimals
    same = F.forall(F.arrays_zip(F.col("vec").alias("e"), F.col("f.vec").alias("g")), lambda p: (p["e"]["at"] == p["g"]["at"]) & (wide(p["e"]["num"]) * v["num"] * p["g"]["den"] * w["den"] == wide(p["g"]["num"]) * w["num"] * p["e"]["den"] * v["den"]))
    return both.filter((F.size("vec") == 0) | ((F.size("vec") == F.size("f.vec")) & same)).select("gen")


def minimize(gens: DataFrame, phi: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The flange without upsets, then downsets, that repeat the first one with their bounds up to a factor; ranks stay."""
    for kind, side in (("up", "up"), ("down", "down")):
        out = cut(_repeated(gens, phi, kind))  # read twice, and by the next kind
        phi = phi.join(out.select(F.col("gen").alias(side)), side, "left_anti")
        gens = gens.join(out.withColumn("kind", F.lit(kind)), ["gen", "kind"], "left_anti")
    return gens, phi.select("down", "up", "num", "den")


def to_axis(gens: DataFrame) -> DataFrame:
    """``gen, kind, corner, free``: births (upsets) and deaths (downsets) by their corner and free directions; a free one's corner is null."""
    up = F.col("kind") == "up"
    corner = F.when(up, F.array("lo_x", "lo_y")).otherwise(F.array("hi_x", "hi_y"))
    return gens.select("gen", "kind", corner.alias("corner")).withColumn("free", F.transform("corner", lambda c: c.isNull()))
