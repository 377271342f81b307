"""Seeded generators of point clouds, images and graphs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def noisy_annulus(spark: SparkSession, n: int, radius: float = 1.0, noise: float = 0.1, seed: int = 0, centre: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    angle, r = F.rand(seed) * (2 * math.pi), F.lit(radius) + F.randn(seed + 1) * noise
    rows = spark.range(n).select(F.col("id").alias("pid"), angle.alias("a"), r.alias("r"))
    return rows.select("pid", (F.lit(centre[0]) + F.col("r") * F.cos("a")).alias("x"), (F.lit(centre[1]) + F.col("r") * F.sin("a")).alias("y"))


def three_annuli(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    parts = [noisy_annulus(spark, n, 1.0, 0.05, seed + 10 * k, (4.0 * k, 0.0)).withColumn("pid", F.col("pid") + k * n) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def gaussian_clusters(spark: SparkSession, n: int, centres: list[tuple[float, float]], sigma: float = 0.1, seed: int = 0) -> DataFrame:
    xs, ys = (F.array(*(F.lit(float(c[i])) for c in centres)) for i in (0, 1))
    k = (F.col("id") % len(centres)).cast("int")
    return spark.range(n).select(F.col("id").alias("pid"), (F.get(xs, k) + F.randn(seed) * sigma).alias("x"), (F.get(ys, k) + F.randn(seed + 1) * sigma).alias("y"), k.alias("label"))


def checkerboard(spark: SparkSession, side: int, square: int = 1) -> DataFrame:
    i, j = F.floor(F.col("id") / side), F.col("id") % side
    return spark.range(side * side).select(i.alias("i"), j.alias("j"), ((F.floor(i / square) + F.floor(j / square)) % 2).cast("double").alias("value"))


def planar_grid_graph(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """``u, v``: edges of the grid, vertices numbered by rows."""
    ids = spark.range(rows * cols).select("id", (F.col("id") % cols).alias("c"), F.floor(F.col("id") / cols).alias("r"))
    right = ids.filter(F.col("c") < cols - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    return right.unionByName(ids.filter(F.col("r") < rows - 1).select(F.col("id").alias("u"), (F.col("id") + cols).alias("v")))


def coupled_orbit(n: int, x: float, y: float, r: float = 1.0) -> list[tuple[int, float, float]]:
    """The orbit of the coupled logistic map on the unit torus: each point follows from the one before, so it is a loop."""
    out = [(0, x, y)]
    for k in range(1, n):
        x = (x + r * y * (1 - y)) % 1.0
        y = (y + r * x * (1 - x)) % 1.0
        out.append((k, x, y))
    return out


# A fringe is two tables: generators (upsets and downsets by their corners) and the matrix phi (down, up, num, den).

_PHI = "down int, up int, num long, den long"
_STAIRS = (((0.0, 0.0), (1.5, 1.0)), ((0.75, 0.5), (2.5, 2.0)), ((1.5, 1.0), (3.5, 3.0)))


def diagonal(spark: SparkSession, n: int, scalars: list[int] | None = None) -> DataFrame:
    return spark.createDataFrame([(k, k, (scalars or [1] * n)[k], 1) for k in range(n)], _PHI)


def bidiagonal(spark: SparkSession, n: int) -> DataFrame:
    """1 on the diagonal, -1 right of it, so neighbours share relations."""
    return spark.createDataFrame([(k, k, 1, 1) for k in range(n)] + [(k, k + 1, -1, 1) for k in range(n - 1)], _PHI)


def chain_fringe(spark: SparkSession, bars: list[tuple[int, int]], coupled: bool = False, scalars: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(``gen, birth, death``, phi): a bar lives on [birth, death] of a chain; coupled bars share relations."""
    if any(b < 1 or d < b for b, d in bars):
        raise ValueError("a bar needs 1 <= birth <= death")
    gens = spark.createDataFrame([(k, b, d) for k, (b, d) in enumerate(bars)], "gen int, birth int, death int")
    return gens, bidiagonal(spark, len(bars)) if coupled else diagonal(spark, len(bars), scalars)


def diamond_fringe(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(``gen, kind, q``, phi) on 1 < 2, 3 < 4: two branches that meet at the top with opposite signs."""
    gens = spark.createDataFrame([(0, "up", 2), (1, "up", 3), (0, "down", 4)], "gen int, kind string, q int")
    return gens, spark.createDataFrame([(0, 0, 1, 1), (0, 1, -1, 1)], _PHI)


def box_fringe(spark: SparkSession, bars: list[tuple[tuple[float, ...], tuple[float, ...]]] = _STAIRS, coupled: bool = False, scalars: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(``gen, kind, lo_x, lo_y, hi_x, hi_y``, phi): boxes as an upset from the lower and a downset to the upper corner."""
    if any(a > b for lo, hi in bars for a, b in zip(lo, hi, strict=True)):
        raise ValueError("a box's lower corner must be below its upper one")
    rows = [(k, "up", *map(float, lo), None, None) for k, (lo, _) in enumerate(bars)] + [(k, "down", None, None, *map(float, hi)) for k, (_, hi) in enumerate(bars)]
    gens = spark.createDataFrame(rows, "gen int, kind string, lo_x double, lo_y double, hi_x double, hi_y double")
    return gens, bidiagonal(spark, len(bars)) if coupled else diagonal(spark, len(bars), scalars)


def halfspaces(gens: DataFrame) -> DataFrame:
    """``gen, kind, part, row, a, b``: boxes as polyhedra a . x <= b, one row for each bounded axis."""
    x, y = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))
    minus = lambda v: F.transform(v, lambda t: -t)
    sides = F.array(*(F.struct(F.lit(r).alias("row"), a.alias("a"), b.alias("b")) for r, a, b in ((0, minus(x), -F.col("lo_x")), (1, minus(y), -F.col("lo_y")), (0, x, F.col("hi_x")), (1, y, F.col("hi_y")))))
    return gens.select("gen", "kind", F.lit(0).alias("part"), F.explode(sides).alias("s")).select("gen", "kind", "part", "s.row", "s.a", "s.b").filter("b is not null")


def mixed_face_flange(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Flats and injectives in Z^2, two strips and a corner of each; a null bound is a free direction."""
    rows = [(0, "up", None, 0.0, None, None), (1, "up", 0.0, None, None, None), (2, "up", 1.0, 1.0, None, None), (0, "down", None, None, None, 2.0), (1, "down", None, None, 2.0, None), (2, "down", None, None, 3.0, 3.0)]
    gens = spark.createDataFrame(rows, "gen int, kind string, lo_x double, lo_y double, hi_x double, hi_y double")
    ones = [(0, 0), (0, 1), (1, 0), (1, 2), (2, 1), (2, 2)]
    return gens, spark.createDataFrame([(d, u, 1, 1) for d, u in ones], _PHI)


def family(f, configs: list[dict], label=None) -> DataFrame:
    """The tables that ``f`` makes of each configuration, one above the other, with their ``label``."""
    if not configs:
        raise ValueError("a family needs a configuration")
    label = label or (lambda c: ",".join(f"{k}={c[k]}" for k in sorted(c) if k != "spark"))
    parts = [f(**c).withColumn("label", F.lit(label(c))) for c in configs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sweep(f, grid: dict[str, list], label=None, **base) -> DataFrame:
    """The family over all combinations of the listed parameters."""
    from itertools import product

    if not grid or any(not v for v in grid.values()):
        raise ValueError("every parameter of a sweep needs a value")
    label = label or (lambda c: ",".join(f"{k}={c[k]}" for k in grid))
    return family(f, [base | dict(zip(grid, values, strict=True)) for values in product(*grid.values())], label)
