"""The engine's inputs, drawn from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RADIUS = 0.1
#: Triangles need a smaller radius: their number grows with the cube of the degree.
TRIANGLE_RADIUS = 0.06
STEP = 0.01
START = 0.05


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point cloud: the first three coordinates of ``embeddings``, with the label as vertex value."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("pid"), *(F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate("xyz")), "label")


POINTS = "p AS (SELECT vec_id AS pid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label FROM embeddings)"
PAIR = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"


def edges_sql(radius: float) -> str:
    return f"{POINTS}, e AS (SELECT a.pid AS u, b.pid AS v, {PAIR} AS d, a.label AS lu, b.label AS lv FROM p a JOIN p b ON a.pid < b.pid WHERE {PAIR} <= {radius}e0)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dim, i, j``: the bipartite graph of parts and suppliers over (discount, quantity), both as integers.

    An edge is a distinct (part, supplier) pair, born at the componentwise least grade of its line items, a vertex at
    the least grade of its edges.
    """
    item = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.rint(F.col("l_discount") * 100).cast("long").alias("i"), F.col("l_quantity").cast("long").alias("j"))
    edge = item.groupBy("l_partkey", "l_suppkey").agg(F.min("i").alias("i"), F.min("j").alias("j"))
    part = edge.groupBy("l_partkey").agg(F.min("i").alias("i"), F.min("j").alias("j"))
    supplier = edge.groupBy("l_suppkey").agg(F.min("i").alias("i"), F.min("j").alias("j"))
    vertex = part.select(F.lit(0).alias("dim"), "i", "j").unionByName(supplier.select(F.lit(0).alias("dim"), "i", "j"))
    return vertex.unionByName(edge.select(F.lit(1).alias("dim"), "i", "j"))


CELLS = (
    "item AS (SELECT l_partkey, l_suppkey, CAST(round_even(l_discount*100, 0) AS BIGINT) AS i, CAST(l_quantity AS BIGINT) AS j FROM lineitem), "
    "edge AS (SELECT l_partkey, l_suppkey, min(i) AS i, min(j) AS j FROM item GROUP BY ALL), "
    "cell AS (SELECT 0 AS dim, min(i) AS i, min(j) AS j FROM edge GROUP BY l_partkey UNION ALL SELECT 0, min(i), min(j) FROM edge GROUP BY l_suppkey UNION ALL SELECT 1, i, j FROM edge)"
)
MEASURE = f"{CELLS}, m AS (SELECT i, j, CAST(sum(CASE WHEN dim % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS w FROM cell GROUP BY i, j HAVING sum(CASE WHEN dim % 2 = 0 THEN 1 ELSE -1 END) <> 0)"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``slice, birth, death, mult``: for each supplier, bars from a quantity over 1 + the discount in hundredths."""
    item = read(spark, sf_dir, "lineitem")
    b = F.col("l_quantity").cast("long")
    return item.groupBy(F.col("l_suppkey").alias("slice"), b.alias("birth"), (b + 1 + F.rint(F.col("l_discount") * 100).cast("long")).alias("death")).agg(F.count(F.lit(1)).alias("mult"))


BARS = "bars AS (SELECT l_suppkey AS slice, CAST(l_quantity AS BIGINT) AS birth, CAST(l_quantity AS BIGINT) + 1 + CAST(round_even(l_discount*100, 0) AS BIGINT) AS death, count(*) AS mult FROM lineitem GROUP BY ALL)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``i, j, value``: an image over (quantity, discount), the number of line items; 50 x 11 at most."""
    item = read(spark, sf_dir, "lineitem")
    return item.groupBy(F.col("l_quantity").cast("long").alias("i"), F.rint(F.col("l_discount") * 100).cast("long").alias("j")).agg(F.count(F.lit(1)).alias("value"))


PIXELS = "px AS (SELECT CAST(l_quantity AS BIGINT) AS i, CAST(round_even(l_discount*100, 0) AS BIGINT) AS j, count(*) AS value FROM lineitem GROUP BY ALL)"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``i, j, region``: the image cut into levels of a tenth of its mean."""
    px = pixels(spark, sf_dir)
    mean = px.agg(F.avg("value").alias("mean"))
    return px.crossJoin(F.broadcast(mean)).select("i", "j", F.floor(F.col("value") / (F.col("mean") / 10)).cast("long").alias("region"))  # one row


LABELS = f"{PIXELS}, lab AS (SELECT i, j, CAST(floor(value / ((SELECT avg(value) FROM px) / 10)) AS BIGINT) AS region FROM px)"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``region, weight, dim, x0, y0, x1, y1``: grid points of a level, its level modulo 4 as dimension."""
    return labels(spark, sf_dir).groupBy("region").agg(F.count(F.lit(1)).cast("double").alias("weight"), (F.first("region") % 4).alias("dim"), F.min("i").alias("x0"), F.min("j").alias("y0"), F.max("i").alias("x1"), F.max("j").alias("y1"))


REGIONS = f"{LABELS}, reg AS (SELECT region, CAST(count(*) AS DOUBLE) AS weight, region % 4 AS dim, min(i) AS x0, min(j) AS y0, max(i) AS x1, max(j) AS y1 FROM lab GROUP BY region)"
ADJACENCY = (
    f"{REGIONS}, touch AS (SELECT a.region AS r0, b.region AS s0 FROM lab a JOIN lab b ON (b.i = a.i + 1 AND b.j = a.j) OR (b.i = a.i AND b.j = a.j + 1) WHERE a.region <> b.region), "
    "adj AS (SELECT least(r0, s0) AS r, greatest(r0, s0) AS s, count(*) AS measure FROM touch GROUP BY ALL)"
)


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): nations, joined when a customer and a supplier of theirs trade; weight is the trades' number."""
    item, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    customer, supplier = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    trade = item.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    pair = trade.groupBy(F.least("c_nationkey", "s_nationkey").cast("long").alias("u"), F.greatest("c_nationkey", "s_nationkey").cast("long").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    mean = pair.agg(F.avg("n").alias("mean"))
    strong = pair.filter("u <> v").crossJoin(F.broadcast(mean)).filter("n > mean").select("u", "v", "n")  # one row
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("pid")), strong


GRAPH = (
    "pair AS (SELECT CAST(least(c_nationkey, s_nationkey) AS BIGINT) AS u, CAST(greatest(c_nationkey, s_nationkey) AS BIGINT) AS v, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), "
    "ge AS (SELECT u, v, n FROM pair WHERE u <> v AND n > (SELECT avg(n) FROM pair)), "
    "gv AS (SELECT CAST(n_nationkey AS BIGINT) AS pid FROM nation), arcs AS (SELECT u, v, n FROM ge UNION ALL SELECT v, u, n FROM ge)"
)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``gen, kind, lo_x, lo_y, hi_x, hi_y``: a box presentation with an upset and a downset for each nation.

    Upsets start at (customers, 10 * region), downsets end at that plus (suppliers + 5, 25); all are integers.
    """
    nation = read(spark, sf_dir, "nation")
    c = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("nc"))
    s = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("ns"))
    base = nation.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select(F.col("n_nationkey").cast("int").alias("gen"), F.coalesce("nc", F.lit(0)).alias("x"), (F.col("n_regionkey") * 10).cast("long").alias("y"), F.coalesce("ns", F.lit(0)).alias("w"))
    none = F.lit(None).cast("long")
    up = base.select("gen", F.lit("up").alias("kind"), F.col("x").alias("lo_x"), F.col("y").alias("lo_y"), none.alias("hi_x"), none.alias("hi_y"))
    down = base.select("gen", F.lit("down").alias("kind"), none.alias("lo_x"), none.alias("lo_y"), (F.col("x") + F.col("w") + 5).alias("hi_x"), (F.col("y") + 25).alias("hi_y"))
    return up.unionByName(down)


BOXES = (
    "base AS (SELECT CAST(n_nationkey AS INTEGER) AS gen, coalesce(nc, 0) AS x, CAST(n_regionkey AS BIGINT) * 10 AS y, coalesce(ns, 0) AS w FROM nation "
    "LEFT JOIN (SELECT c_nationkey, count(*) AS nc FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS ns FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey), "
    "xs AS (SELECT x AS x FROM base UNION SELECT x + w + 5 FROM base), ys AS (SELECT y AS y FROM base UNION SELECT y + 25 FROM base), pt AS (SELECT xs.x, ys.y FROM xs, ys), "
    "ups AS (SELECT pt.x, pt.y, base.gen FROM pt JOIN base ON base.x <= pt.x AND base.y <= pt.y), downs AS (SELECT pt.x, pt.y, base.gen FROM pt JOIN base ON pt.x <= base.x + base.w + 5 AND pt.y <= base.y + 25), "
    "sig AS (SELECT pt.x, pt.y, coalesce((SELECT string_agg(CAST(gen AS VARCHAR), ',' ORDER BY gen) FROM ups WHERE ups.x = pt.x AND ups.y = pt.y), '') AS ups, "
    "coalesce((SELECT string_agg(CAST(gen AS VARCHAR), ',' ORDER BY gen) FROM downs WHERE downs.x = pt.x AND downs.y = pt.y), '') AS downs FROM pt)"
)
