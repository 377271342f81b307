"""Graph vertex functions: degrees, components, distances, centralities, cores, modularity.

Edges are ``u, v`` (with u < v) and optional weights. Iterations are joins with map-side sums; each round is
written to the shared folder and only counters reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import cut


def both_ways(edges: DataFrame, weight: str | None = None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return edges.select("u", "v", w.alias("w")).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), w.alias("w")))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``pid, value``: number of edges; isolated vertices have 0."""
    n = both_ways(edges).groupBy(F.col("u").alias("pid")).agg(F.count(F.lit(1)).alias("n"))
    return vertices.select("pid").join(n, "pid", "left").select("pid", F.coalesce("n", F.lit(0)).alias("value"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``pid, root``: least vertex of the component. Labels spread along edges, then jump to their label's label."""
    arcs = cut(both_ways(edges).select("u", "v"))
    now = cut(vertices.select("pid", F.col("pid").alias("root")))
    while True:
        near = arcs.join(now.select(F.col("pid").alias("v"), "root"), "v").groupBy(F.col("u").alias("pid")).agg(F.min("root").alias("m"))
        step = now.join(near, "pid", "left").select("pid", F.least("root", F.coalesce("m", "root")).alias("root"))
        jump = step.select(F.col("pid").alias("root"), F.col("root").alias("up"))
        then = cut(step.join(jump, "root").select("pid", F.least("root", "up").alias("root")))
        if then.join(now.withColumnRenamed("root", "old"), "pid").filter(F.col("root") != F.col("old")).isEmpty():
            return then
        now = then


def geodesic(vertices: DataFrame, edges: DataFrame, sources: DataFrame, weight: str | None = None) -> DataFrame:
    """``pid, value``: distance to the nearest source (``sources``: pid), relaxed round by round.

    Vertices that no source reaches get the largest finite distance + 1.
    """
    arcs = cut(both_ways(edges, weight))
    now = cut(vertices.select("pid").join(sources.select("pid", F.lit(0.0).alias("value")).distinct(), "pid", "left"))
    while True:
        reach = now.filter(F.col("value").isNotNull()).select(F.col("pid").alias("u"), "value")
        near = arcs.join(reach, "u").groupBy(F.col("v").alias("pid")).agg(F.min(F.col("value") + F.col("w")).alias("m"))
        then = cut(now.join(near, "pid", "left").select("pid", F.least("value", "m").alias("value"), F.col("value").alias("old")))
        done = then.filter(~F.col("value").eqNullSafe(F.col("old"))).isEmpty()
        now = then.drop("old")
        if done:
            far = now.agg((F.coalesce(F.max("value"), F.lit(0.0)) + 1).alias("far"))
            return now.crossJoin(F.broadcast(far)).select("pid", F.coalesce("value", "far").alias("value"))  # one row


def core_numbers(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``pid, value``: the largest k such that a subgraph of least degree k holds the vertex.

    Every vertex starts from its degree and takes the h-index of its neighbours' values until nothing changes, which
    ends at the core numbers; values are counted by size, so a hub's neighbours are never listed.
    """
    arcs = cut(both_ways(edges).select("u", "v"))
    now = cut(degrees(vertices, edges))
    from pyspark.sql import Window

    while True:
        seen = arcs.join(now.select(F.col("pid").alias("v"), F.col("value").alias("k")), "v").join(now.select(F.col("pid").alias("u"), "value"), "u")
        counts = seen.groupBy("u", F.least("k", "value").alias("k")).agg(F.count(F.lit(1)).alias("n"))
        above = F.sum("n").over(Window.partitionBy("u").orderBy(F.col("k").desc()))
        h = counts.withColumn("above", above).groupBy(F.col("u").alias("pid")).agg(F.max(F.least("k", "above")).alias("h"))
        then = cut(now.join(h, "pid", "left").select("pid", F.coalesce("h", F.lit(0)).cast("long").alias("value"), F.col("value").alias("old")))
        if then.filter("value <> old").isEmpty():
            return then.select("pid", "value")
        now = then.select("pid", "value")


def pagerank(vertices: DataFrame, edges: DataFrame, weight: str | None = None, damping: float = 0.85, rounds: int = 200, tolerance: float = 1e-10) -> DataFrame:
    """``pid, value``: ranks that sum to 1, iterated until the largest change is below the tolerance; dangling mass is spread evenly.

    Spreading dangling mass only scales the ranks, so rounds leave it out and the end is scaled. A few rounds make one
    plan, a join and a sum each; then the ranks are written and compared with those before.
    """
    together = 5
    n = vertices.count()
    arcs = both_ways(edges, weight)
    arcs = cut(arcs.join(arcs.groupBy("u").agg(F.sum("w").alias("all")), "u").select("u", F.col("v").alias("pid"), (F.col("w") / F.col("all") * damping).alias("p")))
    now = cut(vertices.select("pid", F.lit(1.0 / max(n, 1)).alias("value")))
    base = vertices.select("pid", F.lit((1 - damping) / max(n, 1)).alias("value"))
    for _ in range(-(-rounds // together)):
        then = now
        for _ in range(together):
            got = arcs.join(then.select(F.col("pid").alias("u"), "value"), "u").select("pid", (F.col("value") * F.col("p")).alias("value"))
            then = got.unionByName(base).groupBy("pid").agg(F.sum("value").alias("value"))
        then = cut(then)
        gap = then.join(now.withColumnRenamed("value", "old"), "pid").agg(F.max(F.abs(F.col("value") - F.col("old")))).first()[0]
        now = then
        if gap is None or gap < tolerance:
            break
    total = now.agg(F.sum("value")).first()[0] or 1.0
    return now.select("pid", (F.col("value") / F.lit(total)).alias("value"))


def eigenvector(vertices: DataFrame, edges: DataFrame, weight: str | None = None, rounds: int = 500, tolerance: float = 1e-10) -> DataFrame:
    """``pid, value``: power iteration from 1 / sqrt(n), scaled to unit length each round; may cycle on bipartite graphs."""
    n = vertices.count()
    arcs = cut(both_ways(edges, weight))
    now = cut(vertices.select("pid", F.lit(1.0 / max(n, 1) ** 0.5).alias("value")))
    for _ in range(rounds):
        got = arcs.join(now.select(F.col("pid").alias("u"), "value"), "u").groupBy(F.col("v").alias("pid")).agg(F.sum(F.col("value") * F.col("w")).alias("s"))
        raw = cut(now.join(got, "pid", "left").select("pid", F.coalesce("s", F.lit(0.0)).alias("s"), F.col("value").alias("old")))
        norm = raw.agg(F.sqrt(F.sum(F.col("s") * F.col("s")))).first()[0]
        if not norm:
            return raw.select("pid", F.lit(0.0).alias("value"))
        then = raw.select("pid", (F.abs("s") / F.lit(norm)).alias("value"), "old")
        gap = then.agg(F.max(F.abs(F.col("value") - F.col("old")))).first()[0]
        now = cut(then.select("pid", "value"))
        if gap < tolerance:
            break
    return now


def modularity(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``modularity``: sum over labels of (inner edges / m - (total degree / 2m)^2). ``labels``: pid, label."""
    lab = lambda c: labels.select(F.col("pid").alias(c), F.col("label").alias(f"l_{c}"))
    e = edges.select("u", "v").join(lab("u"), "u").join(lab("v"), "v")
    inner = e.filter("l_u = l_v").groupBy(F.col("l_u").alias("label")).agg(F.count(F.lit(1)).alias("inside"))
    ends = e.select(F.col("l_u").alias("label")).unionByName(e.select(F.col("l_v").alias("label"))).groupBy("label").agg(F.count(F.lit(1)).alias("deg"))
    m = ends.agg((F.sum("deg") / 2).alias("m"))
    rows = ends.join(inner, "label", "left").crossJoin(F.broadcast(m))  # one row
    share = F.col("deg") / (2 * F.col("m"))
    return rows.agg(F.sum(F.coalesce("inside", F.lit(0)) / F.col("m") - share * share).alias("modularity"))


def spanning_forest(edges: DataFrame, weight: str = "d") -> DataFrame:
    """``u, v, d``: the least spanning forest by rounds of cheapest outgoing edges (ties by edge).

    Its weights are the deaths of degree-0 persistence.
    """
    key = F.struct(F.col(weight).alias("d"), "u", "v")
    live = cut(edges.select("u", "v", key.alias("e"), F.col("u").alias("a"), F.col("v").alias("b")))
    chosen = None
    while not live.isEmpty():
        ends = live.select(F.col("a").alias("c"), "e").unionByName(live.select(F.col("b").alias("c"), "e"))
        best = cut(ends.groupBy("c").agg(F.min("e").alias("e")).select("e").distinct())
        chosen = best if chosen is None else chosen.unionByName(best)
        joined = live.join(best, "e", "left_semi").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        nodes = live.select(F.col("a").alias("pid")).unionByName(live.select(F.col("b").alias("pid"))).distinct()
        root = components(nodes, joined.distinct())
        moved = live.join(root.select(F.col("pid").alias("a"), F.col("root").alias("ra")), "a").join(root.select(F.col("pid").alias("b"), F.col("root").alias("rb")), "b")
        live = cut(moved.filter("ra <> rb").select("u", "v", "e", F.col("ra").alias("a"), F.col("rb").alias("b")))
    if chosen is None:
        return edges.select("u", "v", weight).limit(0)
    return chosen.select("e.u", "e.v", "e.d")
