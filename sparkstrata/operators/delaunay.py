"""Planar Delaunay complexes and the families on them: alpha, function-Delaunay, core-Delaunay.

A table holds many clouds (``cloud, pid, x, y``); each is triangulated in one grouped kernel, so a run spreads over
clouds. Triangles come from incremental insertion; points that coincide keep the least id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _orient(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _in_circle(a, b, c, p) -> float:
    """Positive if p lies inside the circle through a, b, c (in counter-clockwise order)."""
    m = np.array([[q[0] - p[0], q[1] - p[1], (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2] for q in (a, b, c)])
    return float(np.linalg.det(m))


def triangulate(xy: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of the Delaunay triangulation, as ascending index triples."""
    n = len(xy)
    if n < 3:
        return []
    mid, span = xy.mean(0), max(float(np.ptp(xy, axis=0).max()), 1e-9)
    pts = np.vstack((xy, mid + np.array([[-1e4, -1e4], [1e4, -1e4], [0, 1e4]]) * span))
    found = {(n, n + 1, n + 2)}
    for i in range(n):
        bad = [t for t in found if _in_circle(*(pts[k] for k in t), pts[i]) > 1e-12 * span**4]
        sides: dict[tuple[int, int], tuple[int, int]] = {}
        for a, b, c in bad:
            for u, v in ((a, b), (b, c), (c, a)):
                if (v, u) in sides:
                    del sides[v, u]
                else:
                    sides[u, v] = (u, v)
        found -= set(bad)
        for u, v in sides:
            if _orient(pts[u], pts[v], pts[i]) > 0:
                found.add((u, v, i))
    return sorted(tuple(sorted(t)) for t in found if max(t) < n)


def circumradius(a, b, c) -> float:
    sides = [float(np.hypot(*(p - q))) for p, q in ((a, b), (b, c), (c, a))]
    area = abs(_orient(a, b, c)) / 2
    return sides[0] * sides[1] * sides[2] / (4 * area) if area else float("inf")


def cells(points: DataFrame) -> DataFrame:
    """``cloud, dim, verts, radius, alpha``: radius is half an edge's length or a triangle's circumradius, alpha is squared.

    An edge's alpha is its squared radius if no third vertex of its triangles lies inside its circle, else the least
    squared circumradius of its triangles.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid").drop_duplicates(["x", "y"])
        xy, ids = pdf[["x", "y"]].to_numpy(float), pdf["pid"].tolist()
        cloud = pdf["cloud"].iloc[0]
        rows = [(cloud, 0, [i], 0.0, 0.0) for i in ids]
        edges: dict[tuple[int, int], list] = {}
        tri = triangulate(xy)
        for t in tri:
            r = circumradius(*(xy[k] for k in t))
            rows.append((cloud, 2, [ids[k] for k in t], r, r * r))
            for u, v, w in ((t[0], t[1], t[2]), (t[0], t[2], t[1]), (t[1], t[2], t[0])):
                edges.setdefault((u, v), []).append((w, r * r))
        if not tri and len(xy) == 2:
            edges[0, 1] = []
        elif not tri and len(xy) > 2:  # all on one line
            order = np.lexsort((xy[:, 1], xy[:, 0]))
            edges = {tuple(sorted((int(a), int(b)))): [] for a, b in zip(order, order[1:], strict=False)}
        for (u, v), near in edges.items():
            centre, half = (xy[u] + xy[v]) / 2, float(np.hypot(*(xy[u] - xy[v]))) / 2
            inside = any(float(((xy[w] - centre) ** 2).sum()) < half * half - 1e-12 for w, _ in near)
            rows.append((cloud, 1, [ids[u], ids[v]], half, min(a for _, a in near) if inside else half * half))
        return pd.DataFrame(rows, columns=["cloud", "dim", "verts", "radius", "alpha"])

    kind = points.schema["cloud"].dataType.simpleString()
    return points.groupBy("cloud").applyInPandas(run, f"cloud {kind}, dim int, verts array<long>, radius double, alpha double")


def function_cells(found: DataFrame, values: DataFrame, agg: str = "max") -> DataFrame:
    """``cloud, dim, verts, g1, g2``: (radius, aggregated vertex value). ``values``: cloud, pid, value."""
    each = found.select("cloud", "dim", "verts", "radius", F.explode("verts").alias("pid")).join(values, ["cloud", "pid"])
    fold = {"max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg}[agg]
    return each.groupBy("cloud", "dim", "verts", F.col("radius").alias("g1")).agg(fold("value").alias("g2"))


__all__ = ["cells", "circumradius", "function_cells", "triangulate"]
