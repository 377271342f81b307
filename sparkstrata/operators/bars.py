"""Barcodes: summaries, landscapes, silhouettes, images, and distances between diagrams.

A bar table has ``slice, birth, death, mult``; bars are half-open, [birth, death). Everything set-shaped is one grouped
aggregate or a join with a small grid of t values (a parameter, not data). Distances between two diagrams are matching
problems; they run in one grouped numpy kernel for each slice.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import kernel, tent


def persistence(p: float = 1.0) -> Column:
    return F.pow((F.col("death") - F.col("birth")).cast("double"), p)


def summary(bars: DataFrame) -> DataFrame:
    """``slice, n_bars, total, longest, mean, l2``."""
    life = (F.col("death") - F.col("birth")).cast("double")
    return bars.groupBy("slice").agg(
        F.sum("mult").alias("n_bars"), F.sum(life * F.col("mult")).alias("total"), F.max(life).alias("longest"),
        (F.sum(life * F.col("mult")) / F.sum("mult")).alias("mean"), F.sqrt(F.sum(life * life * F.col("mult"))).alias("l2"),
    )


def entropy(bars: DataFrame, p: float = 1.0, normalize: bool = True) -> DataFrame:
    """``slice, entropy``: Shannon entropy of the persistence shares; divided by log n if asked, 0 for a single bar."""
    w = persistence(p)
    sums = bars.filter("death > birth").groupBy("slice").agg(F.sum(w * F.col("mult")).alias("s"), F.sum(w * F.log(w) * F.col("mult")).alias("sl"), F.sum("mult").alias("n"))
    h = F.log("s") - F.col("sl") / F.col("s")
    return sums.select("slice", F.when(F.col("n") <= 1, F.lit(0.0)).otherwise(h / F.log("n") if normalize else h).alias("entropy"))


def _on_grid(bars: DataFrame, ts: Sequence[float]) -> DataFrame:
    """Each bar with the grid values inside it, and its tent there. The grid is a parameter array, found by its step."""
    grid = F.array(*(F.lit(float(t)) for t in ts))
    rows = bars.withColumn("t", F.explode(F.filter(grid, lambda t: (t > F.col("birth")) & (t < F.col("death")))))
    return rows.withColumn("tent", tent(F.col("birth").cast("double"), F.col("death").cast("double"), F.col("t")))


def landscape(bars: DataFrame, ts: Sequence[float], kmax: int) -> DataFrame:
    """``slice, k, t, value``: the k-th largest tent over t, for positive values only.

    Equal tents are one row with their multiplicity summed before they are ranked, so a hot slice ranks its distinct
    heights only.
    """
    heights = _on_grid(bars, ts).groupBy("slice", "t", "tent").agg(F.sum("mult").alias("m"))
    seen = F.coalesce(F.sum("m").over(Window.partitionBy("slice", "t").orderBy(F.col("tent").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = heights.withColumn("before", seen).filter(F.col("before") < kmax)
    ks = F.sequence((F.col("before") + 1).cast("int"), F.least(F.col("before") + F.col("m"), F.lit(kmax)).cast("int"))
    return ranked.select("slice", F.explode(ks).alias("k"), "t", F.col("tent").alias("value"))


def silhouette(bars: DataFrame, ts: Sequence[float], p: float = 1.0) -> DataFrame:
    """``slice, t, value``: tents weighted by persistence^p over the sum of all weights of the slice."""
    total = bars.groupBy("slice").agg(F.sum(persistence(p) * F.col("mult")).alias("all"))
    top = _on_grid(bars, ts).groupBy("slice", "t").agg(F.sum(persistence(p) * F.col("mult") * F.col("tent")).alias("s"))
    return top.join(total, "slice").select("slice", "t", (F.col("s") / F.col("all")).alias("value"))


def betti_curve(bars: DataFrame, ts: Sequence[float]) -> DataFrame:
    """``slice, t, n``: bars alive at t."""
    grid = F.array(*(F.lit(float(t)) for t in ts))
    rows = bars.withColumn("t", F.explode(F.filter(grid, lambda t: (t >= F.col("birth")) & (t < F.col("death")))))
    return rows.groupBy("slice", "t").agg(F.sum("mult").alias("n"))


def image(bars: DataFrame, xs: Sequence[float], ys: Sequence[float], sigma: float, p: float = 1.0) -> DataFrame:
    """``slice, x, y, value``: Gaussians at (birth, persistence), weighted by persistence^p, at the grid's points.

    Equal bars are summed first, so the work is distinct bars times pixels.
    """
    once = bars.groupBy("slice", "birth", "death").agg(F.sum("mult").alias("mult"))
    gx, gy = (F.explode(F.array(*(F.lit(float(v)) for v in g))) for g in (xs, ys))
    rows = once.withColumn("x", gx).withColumn("y", gy)
    dx, dy = F.col("x") - F.col("birth"), F.col("y") - (F.col("death") - F.col("birth"))
    return rows.groupBy("slice", "x", "y").agg(F.sum(persistence(p) * F.col("mult") * kernel(F.sqrt(dx * dx + dy * dy), "gaussian", sigma)).alias("value"))


def top_k(bars: DataFrame, k: int) -> DataFrame:
    """``slice, rank, birth, persistence``: by persistence downwards, then birth, then death. A top-k report."""
    flat = bars.withColumn("life", F.col("death") - F.col("birth"))
    order = Window.partitionBy("slice").orderBy(F.col("life").desc(), "birth", "death")
    before = F.coalesce(F.sum("mult").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = flat.groupBy("slice", "birth", "death", "life").agg(F.sum("mult").alias("mult")).withColumn("before", before).filter(F.col("before") < k)
    ranks = F.sequence((F.col("before") + 1).cast("int"), F.least(F.col("before") + F.col("mult"), F.lit(k)).cast("int"))
    return rows.select("slice", F.explode(ranks).alias("rank"), "birth", F.col("life").alias("persistence"))


def landscape_distance(a: DataFrame, b: DataFrame, step: float, order: float = 2.0, weights: DataFrame | None = None) -> DataFrame:
    """(sum over slices and layers of weight times the trapezoid rule of |a - b|^order)^(1/order) on an even grid.

    Missing rows are zeros; the outer grid values must lie outside all bars, as ``landscape`` leaves zeros out.
    """
    both = a.select("slice", "k", "t", F.col("value").alias("x")).join(b.select("slice", "k", "t", F.col("value").alias("y")), ["slice", "k", "t"], "full")
    gap = F.pow(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))), order)
    if weights is not None:
        both = both.join(weights, "slice")
        gap = gap * F.col("weight")
    return both.agg(F.pow(F.sum(gap) * F.lit(float(step)), 1.0 / order).alias("distance"))


def landscape_inner(a: DataFrame, b: DataFrame, step: float) -> DataFrame:
    both = a.select("slice", "k", "t", F.col("value").alias("x")).join(b.select("slice", "k", "t", F.col("value").alias("y")), ["slice", "k", "t"])
    return both.agg((F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0)) * F.lit(float(step))).alias("inner_product"))


def from_rank(rank: DataFrame, length: int) -> DataFrame:
    """Bars of a chain from its rank table: mult(b, d) = r[b,d-1] - r[b-1,d-1] - r[b,d] + r[b-1,d]; death length + 1 is open."""
    from .grids import rectangles_of_rank

    return rectangles_of_rank(rank).select(F.col("lo").alias("birth"), (F.col("hi") + 1).alias("death"), F.col("w").alias("mult"))


# ---- matchings (numpy kernels) ----


def _costs(a: np.ndarray, b: np.ndarray, q: float) -> np.ndarray:
    """Square cost matrix of two diagrams with their diagonals. Ground metric L^q."""
    n, m = len(a), len(b)
    c = np.zeros((n + m, n + m))
    if n and m:
        gap = np.abs(a[:, None, :] - b[None, :, :])
        c[:n, :m] = gap.max(2) if np.isinf(q) else (gap**q).sum(2) ** (1 / q)
    half = 2 ** (1 / q - 1) if not np.isinf(q) else 0.5
    c[:n, m:] = ((a[:, 1] - a[:, 0]) * half)[:, None]
    c[n:, :m] = ((b[:, 1] - b[:, 0]) * half)[None, :]
    return c


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a least-cost perfect matching (shortest augmenting paths with potentials)."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    match = np.zeros(n + 1, int)
    for row in range(1, n + 1):
        match[0], col = row, 0
        least, back, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while match[col]:
            used[col] = True
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[match[col] - 1, free - 1] - u[match[col]] - v[free]
            better = slack < least[free]
            least[free[better]], back[free[better]] = slack[better], col
            nxt = free[np.argmin(least[free])]
            step = least[nxt]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            col = nxt
        while col:
            match[col], col = match[back[col]], back[col]
    out = np.zeros(n, int)
    out[match[1:] - 1] = np.arange(n)
    return out


def transport(cost: np.ndarray, supply: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """Least-cost flow that moves integer supplies (rows) to equal demands (columns): shortest augmenting paths.

    A path moves as much as fits, so the work grows with distinct points, not with their counts.
    """
    n, m = cost.shape
    u, v, flow, left = np.zeros(n), np.zeros(m), np.zeros((n, m), np.int64), demand.astype(np.int64).copy()
    for row in range(n):
        need = int(supply[row])
        while need:
            dist, back, used = np.full(m, np.inf), np.zeros(m, int), np.zeros(m, bool)
            reached, fresh, at = {row: (0.0, -1)}, [row], 0.0
            while True:
                for r in fresh:
                    slack = at + cost[r] - u[r] - v
                    better = ~used & (slack < dist)
                    dist[better], back[better] = slack[better], r
                open_ = np.where(used, np.inf, dist)
                col = int(open_.argmin())
                at = float(open_[col])
                used[col] = True
                if left[col]:
                    break
                fresh = [int(r) for r in np.flatnonzero(flow[:, col]) if int(r) not in reached]
                for r in fresh:
                    reached[r] = (at, col)
            path, c = [], col
            while True:
                r = int(back[c])
                path.append((r, c, reached[r][1]))
                if r == row:
                    break
                c = reached[r][1]
            moved = min([need, int(left[col]), *(int(flow[r, out]) for r, _, out in path if r != row)])
            for r, c, out in path:
                flow[r, c] += moved
                if r != row:
                    flow[r, out] -= moved
            for r, (d, _) in reached.items():
                u[r] += at - d
            v[used] -= at - dist[used]
            left[col] -= moved
            need -= moved
    return flow


def _counted(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(a, axis=0, return_counts=True) if len(a) else (a.reshape(0, 2), np.zeros(0, np.int64))


def _ground(a: np.ndarray, b: np.ndarray, q: float) -> np.ndarray:
    gap = np.abs(a[:, None, :] - b[None, :, :])
    return gap.max(2) if np.isinf(q) else (gap**q).sum(2) ** (1 / q)


def wasserstein(a: np.ndarray, b: np.ndarray, p: float = 2.0, q: float = np.inf) -> float:
    """Exact, with the diagonal as one more point of each diagram that takes what is left."""
    (x, m), (y, n) = _counted(a), _counted(b)
    if not len(x) and not len(y):
        return 0.0
    half = 2 ** (1 / q - 1) if not np.isinf(q) else 0.5
    c = np.zeros((len(x) + 1, len(y) + 1))
    c[:-1, :-1] = _ground(x, y, q)
    c[:-1, -1], c[-1, :-1] = (x[:, 1] - x[:, 0]) * half, (y[:, 1] - y[:, 0]) * half
    c = c**p
    return float((c * transport(c, np.append(m, n.sum()), np.append(n, m.sum()))).sum() ** (1 / p))


def covers(allowed: np.ndarray) -> bool:
    """Can every row have a column of its own among its allowed ones? Columns are bits of whole numbers."""
    rows = [int.from_bytes(np.packbits(r, bitorder="little").tobytes(), "little") for r in allowed]
    free, owner = (1 << allowed.shape[1]) - 1, {}
    for i, own in enumerate(rows):
        hit = own & free
        seen, queue, back = 0, [i], {}
        r = i
        while not hit:
            if not queue:
                return False
            r = queue.pop()
            new = rows[r] & ~seen
            seen |= new
            hit = new & free
            while new and not hit:
                low = new & -new
                new ^= low
                c = low.bit_length() - 1
                back[c] = r
                queue.append(owner[c])
        c = (hit & -hit).bit_length() - 1
        free ^= 1 << c
        taken = {x: k for k, x in owner.items()} if r != i else {}
        while True:  # turn the path over
            before = taken.get(r)
            owner[c] = r
            if r == i:
                break
            c = before
            r = back[c]
    return True


def bottleneck(a: np.ndarray, b: np.ndarray) -> float:
    """Exact bottleneck distance: the least candidate value at which both diagrams' longer bars can be matched.

    Bars of at most twice the value may go to the diagonal. The others of either side need partners; if each side's can
    be matched into the other diagram, some matching covers both at once (Mendelsohn and Dulmage).
    """
    if not len(a) and not len(b):
        return 0.0
    c = _ground(a, b, np.inf) if len(a) and len(b) else np.zeros((len(a), len(b)))
    x, y = (d[:, 1] - d[:, 0] if len(d) else np.zeros(0) for d in (a, b))
    values = np.unique(np.concatenate((c.ravel(), x / 2, y / 2, [0.0])))

    def fits(e: float) -> bool:
        near = c <= e
        return covers(near[x / 2 > e]) and covers(near.T[y / 2 > e])

    lo, hi = 0, len(values) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        if fits(values[mid]):
            hi = mid
        else:
            lo = mid + 1
    return float(values[lo])


def _points(pdf: pd.DataFrame) -> np.ndarray:
    return np.repeat(pdf[["birth", "death"]].to_numpy(float), pdf["mult"].to_numpy(int), axis=0)


def slice_distances(a: DataFrame, b: DataFrame, kind: str = "bottleneck", p: float = 2.0, q: float = np.inf) -> DataFrame:
    """``slice, distance`` of two bar tables; a slice that only one has meets an empty diagram. Deaths are finite."""
    if kind not in ("bottleneck", "wasserstein"):
        raise ValueError(f"unknown distance {kind}")

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        s, t = (_points(rows[rows["side"] == i]) for i in (0, 1))
        return pd.DataFrame({"slice": [key[0]], "distance": [bottleneck(s, t) if kind == "bottleneck" else wasserstein(s, t, p, q)]})

    side = lambda df, i: df.select("slice", "birth", "death", "mult", F.lit(i).alias("side"))
    kind_of = a.schema["slice"].dataType.simpleString()
    return side(a, 0).unionByName(side(b, 1)).groupBy("slice").applyInPandas(run, f"slice {kind_of}, distance double")


def matching_distance(a: DataFrame, b: DataFrame, weights: DataFrame, kind: str = "bottleneck") -> DataFrame:
    """Approximate matching distance: the largest weighted slice distance. ``weights``: slice, weight."""
    return slice_distances(a, b, kind).join(weights, "slice").agg(F.max(F.col("weight") * F.col("distance")).alias("distance"))


def sliced_distance(a: DataFrame, b: DataFrame, weights: DataFrame, kind: str = "wasserstein", p: float = 2.0, q: float = 1.0, agg: str = "mean") -> DataFrame:
    """Slice distances averaged by weight (mean), in p-mean, or their maximum."""
    rows = slice_distances(a, b, kind, p, q).join(weights, "slice")
    w, d = F.col("weight"), F.col("distance")
    if agg == "mean":
        out = F.sum(w * d) / F.sum(w)
    elif agg == "pmean":
        out = F.pow(F.sum(w * F.pow(d, p)) / F.sum(w), 1.0 / p)
    elif agg == "maximum":
        out = F.max(d)
    else:
        raise ValueError(f"unknown aggregate {agg}")
    return rows.agg(out.alias("distance"))
