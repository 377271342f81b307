"""Readers of the exchange formats and of plain tables, and the engine's own formats.

Text formats are read as lines and parsed by built-in functions, so a file is split over tasks. Distance matrices become
edge tables. Ids in results start at 0 unless said otherwise.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUFFIXES = {".json": "json", ".csv": "csv", ".tsv": "tsv", ".txt": "txt", ".bin": "bin", ".parquet": "parquet"}
#: First number of a binary distance-matrix file of the DIPHA kind (fixed value).
DIPHA_MAGIC = 8067171840


def format_of(path: str) -> str:
    for suffix, name in SUFFIXES.items():
        if path.lower().endswith(suffix):
            return name
    raise ValueError(f"unknown format: {path}")


def inspect(spark: SparkSession, path: str, rows: int = 10) -> dict:
    """Columns, types, a few rows and the guessed kind of a delimited file."""
    sep = {"csv": ",", "tsv": "\t", "txt": " "}[format_of(path)]
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=True)
    kinds = dict(df.dtypes)
    numeric = [c for c, t in kinds.items() if t in ("int", "bigint", "double")]
    kind = "graph" if {"u", "v"} <= {c.lower() for c in df.columns} else "points" if len(numeric) == len(df.columns) else "table"
    return {"format": format_of(path), "columns": kinds, "rows": [r.asDict() for r in df.limit(rows).collect()], "kind": kind}


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """``row, parts``: numbered non-empty lines that aren't comments, split at blanks and commas.

    A file is one document; its lines are numbered by position in the file, kept by one sort of the line table.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    held = lines.filter((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    pid = held.withColumn("p", F.shiftrightunsigned("at", 33))
    before = pid.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    base = before.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row a partition
    row = F.row_number().over(Window.partitionBy("p").orderBy("at")) - 1
    return pid.withColumn("k", row).join(F.broadcast(base), "p").select((F.col("k") + F.col("base")).cast("long").alias("row"), F.split(F.trim("value"), r"[\s,;]+").alias("parts"))


def points(spark: SparkSession, path: str) -> DataFrame:
    """``pid, coords`` from blank- or comma-separated coordinates."""
    return _numbered(spark, path).select(F.col("row").alias("pid"), F.transform("parts", lambda x: x.cast("double")).alias("coords"))


def point_table(spark: SparkSession, path: str, missing: str = "error") -> DataFrame:
    """``pid, coords`` from a delimited file with a header; missing values raise or drop the row."""
    sep = {"csv": ",", "tsv": "\t", "txt": " "}[format_of(path)]
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=True)
    cols = [c for c, t in df.dtypes if t in ("int", "bigint", "double")]
    rows = df.select(*(F.col(c).cast("double") for c in cols))
    if missing == "error" and not rows.filter(" or ".join(f"`{c}` is null" for c in cols)).isEmpty():
        raise ValueError("missing values; use missing='drop_rows'")
    return rows.dropna().select(F.monotonically_increasing_id().alias("pid"), F.array(*cols).alias("coords"))


def edge_table(spark: SparkSession, path: str) -> DataFrame:
    """``u, v, w`` from a delimited file with columns u, v and maybe w; ids are positive."""
    sep = {"csv": ",", "tsv": "\t", "txt": " "}[format_of(path)]
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=True)
    w = F.col("w").cast("double") if "w" in df.columns else F.lit(1.0)
    out = df.select(F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v"), w.alias("w"))
    if not out.filter("u < 1").isEmpty():
        raise ValueError("ids must be positive")
    return out


def image_table(spark: SparkSession, path: str) -> DataFrame:
    """``i, j, value`` from rows of numbers."""
    return _numbered(spark, path).select(F.col("row").alias("i"), F.posexplode("parts").alias("j", "value")).select("i", F.col("j").cast("long"), F.col("value").cast("double"))


def distance_matrix(spark: SparkSession, path: str, part: str = "full", radius: float | None = None) -> DataFrame:
    """``u, v, d`` (u < v) from a full matrix, or its lower or upper triangle, with or without the diagonal.

    A triangle of n rows of lengths 1 to n has the diagonal if all its places there are 0; else its points are n + 1.
    """
    rows = _numbered(spark, path)
    n_rows, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("parts"))).first()
    flat = rows.select(F.col("row").alias("r"), F.size("parts").alias("len"), F.posexplode("parts").alias("c", "d")).withColumn("d", F.col("d").cast("double"))
    if part == "full":
        if n_rows != longest:
            raise ValueError("the matrix isn't square")
        flip = flat.select(F.col("c").alias("r"), F.col("r").alias("c"), F.col("d").alias("e"))
        if not flat.join(flip, ["r", "c"]).filter(F.abs(F.col("d") - F.col("e")) > 1e-10).isEmpty():
            raise ValueError("the matrix isn't symmetric")
        out = flat.filter("r < c").select(F.col("r").cast("long").alias("u"), F.col("c").cast("long").alias("v"), "d")
    elif part == "lower":
        off = rows.filter((F.size("parts") != F.col("row") + 1) | (F.element_at("parts", -1).cast("double") != 0))
        shift = 0 if off.isEmpty() else 1
        out = flat.select(F.col("c").cast("long").alias("u"), (F.col("r") + shift).cast("long").alias("v"), "d").filter("u < v")
    elif part == "upper":
        off = rows.filter((F.size("parts") != n_rows - F.col("row")) | (F.get("parts", F.lit(0)).cast("double") != 0))
        shift = 0 if off.isEmpty() else 1
        out = flat.select(F.col("r").cast("long").alias("u"), (F.col("r") + F.col("c") + shift).cast("long").alias("v"), "d").filter("u < v")
    else:
        raise ValueError(f"unknown part {part}")
    return out.filter(F.col("d") <= radius) if radius is not None else out


def sparse_distances(spark: SparkSession, path: str, radius: float | None = None) -> DataFrame:
    """``u, v, d`` from rows ``i j d``; any index 0 means ids from 0, else from 1; repeated pairs keep the least d."""
    rows = _numbered(spark, path).select(*(F.get("parts", F.lit(i)).cast("long").alias(c) for i, c in enumerate("ij")), F.get("parts", F.lit(2)).cast("double").alias("d"))
    zero = rows.agg(F.min(F.least("i", "j"))).first()[0] == 0
    rows = rows.select((F.col("i") - (0 if zero else 1)).alias("i"), (F.col("j") - (0 if zero else 1)).alias("j"), "d").filter("i <> j")
    out = rows.groupBy(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")).agg(F.min("d").alias("d"))
    return out.filter(F.col("d") <= radius) if radius is not None else out


def _binary(spark: SparkSession, path: str, parse) -> DataFrame:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for content in pdf["content"]:
                yield from parse(bytes(content))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "u long, v long, d double")


def binary_lower_distance(spark: SparkSession, path: str, radius: float | None = None) -> DataFrame:
    """``u, v, d`` from a flat lower triangle of doubles, without the diagonal."""

    def parse(raw: bytes) -> Iterator[pd.DataFrame]:
        values = struct.unpack(f"<{len(raw) // 8}d", raw[: len(raw) // 8 * 8])
        at, row = 0, 1
        while at < len(values):
            part = values[at : at + row]
            yield pd.DataFrame({"u": range(len(part)), "v": row, "d": part})
            at, row = at + row, row + 1

    out = _binary(spark, path, parse)
    return out.filter(F.col("d") <= radius) if radius is not None else out


def dipha_distances(spark: SparkSession, path: str, radius: float | None = None) -> DataFrame:
    """``u, v, d`` from a binary matrix: magic, type, n, then n * n doubles."""

    def parse(raw: bytes) -> Iterator[pd.DataFrame]:
        magic, _, n = struct.unpack("<3q", raw[:24])
        if magic != DIPHA_MAGIC:
            raise ValueError("not a distance matrix of this kind")
        for i in range(n):
            row = struct.unpack(f"<{n}d", raw[24 + 8 * n * i : 24 + 8 * n * (i + 1)])
            yield pd.DataFrame({"u": i, "v": range(i + 1, n), "d": row[i + 1 :]})

    out = _binary(spark, path, parse)
    return out.filter(F.col("d") <= radius) if radius is not None else out


def simplex_lines(spark: SparkSession, path: str, with_dim: bool = True) -> DataFrame:
    """``verts, grade`` from rows ``[dim] v ... filtration``."""
    parts = F.col("parts")
    start = 2 if with_dim else 1
    verts = F.transform(F.slice(parts, start, F.size(parts) - start), lambda x: x.cast("long"))
    return _numbered(spark, path).select(verts.alias("verts"), F.element_at(parts, -1).cast("double").alias("grade"))


def simplex_json(spark: SparkSession, path: str) -> DataFrame:
    """``verts, grade`` from ``{simplices: [[int]], filtration: [double]}``."""
    df = spark.read.schema("simplices array<array<long>>, filtration array<double>").json(path, multiLine=True)
    return df.select(F.explode(F.arrays_zip(F.col("simplices").alias("verts"), F.col("filtration").alias("grade"))).alias("s")).select("s.verts", "s.grade")


def bifiltration(spark: SparkSession, path: str) -> DataFrame:
    """``verts, g1, g2``: one row for each grade, from ``simplex ; grades`` lines after a ``--datatype bifiltration`` line."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> ''")
    if lines.filter(F.col("v").rlike(r"^--datatype\s+bifiltration")).isEmpty():
        raise ValueError("the file isn't a bifiltration")
    body = lines.filter(F.col("v").contains(";") & ~F.col("v").startswith("--") & ~F.col("v").startswith("#"))
    halves = F.split("v", ";")
    nums = lambda c, kind: F.transform(F.filter(F.split(c, r"\s+"), lambda x: x != ""), lambda x: x.cast(kind))
    rows = body.select(nums(F.get(halves, F.lit(0)), "long").alias("verts"), nums(F.get(halves, F.lit(1)), "double").alias("g"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("g") / 2).cast("int") - 1), lambda i: F.struct(F.get("g", 2 * i).alias("g1"), F.get("g", 2 * i + 1).alias("g2")))
    return rows.select("verts", F.explode(pairs).alias("p")).select("verts", "p.g1", "p.g2")


def save_json(path: str, kind: str, payload: dict) -> None:
    """An object of the engine's own JSON format: kind, version, payload."""
    with open(path, "w") as f:
        json.dump({"kind": kind, "version": 1, "payload": payload}, f, sort_keys=True)


def load_json(path: str, kind: str) -> dict:
    """Strict: the kind and version must match and no other key may be there."""
    with open(path) as f:
        found = json.load(f)
    if set(found) != {"kind", "version", "payload"} or found["kind"] != kind or found["version"] != 1:
        raise ValueError(f"{path} isn't a {kind} of version 1")
    return found["payload"]


def save_features(df: DataFrame, path: str, format: str = "parquet") -> None:  # noqa: A002
    df.write.mode("overwrite").format(format).options(**({"header": "true"} if format == "csv" else {})).save(path)


def load_features(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:  # noqa: A002
    return spark.read.format(format).options(**({"header": "true", "inferSchema": "true"} if format == "csv" else {})).load(path)


_READERS = {
    "points": {"csv": point_table, "tsv": point_table, "txt": points},
    "graph": {"csv": edge_table, "tsv": edge_table, "txt": edge_table},
    "image": {"csv": image_table, "tsv": image_table, "txt": image_table},
    "distance": {"csv": distance_matrix, "tsv": distance_matrix, "txt": distance_matrix, "bin": binary_lower_distance},
    "complex": {"txt": simplex_lines, "json": simplex_json},
    "features": {"parquet": lambda spark, path, **more: load_features(spark, path, "parquet", **more)},
}


def load(spark: SparkSession, path: str, kind: str = "auto", **options) -> DataFrame:
    """Any readable file by its suffix and kind (points, graph, image, distance, complex, features); options go to its reader.

    Without a kind a delimited file is looked at: columns u and v make a graph, else it is points; JSON is a complex,
    Parquet features and a binary file a distance matrix.
    """
    form = format_of(path)
    if kind == "auto":
        kind = {"json": "complex", "parquet": "features", "bin": "distance", "txt": "points"}.get(form) or ("graph" if inspect(spark, path, 0)["kind"] == "graph" else "points")
    reader = _READERS.get(kind, {}).get(form)
    if reader is None:
        raise ValueError(f"a {form} file can't be read as {kind}")
    return reader(spark, path, **options)


def _exact(num, den):
    """An exact fraction as the text ``num/den``, whole numbers without their denominator."""
    return F.when(den == 1, num.cast("string")).otherwise(F.concat(num.cast("string"), F.lit("/"), den.cast("string")))


def save_flange_json(gens: DataFrame, phi: DataFrame, path: str) -> None:
    """A flange (tables as in ``operators.flanges``) as one JSON document: corners ``b``, free axes ``tau`` from 1, a dense phi.

    Corners of free axes are written as 0. The document is one line of one file, as large as the presentation.
    """
    spark = gens.sparkSession
    doc = F.lit(0).alias("one")

    def side(kind: str, x: str, y: str) -> DataFrame:
        free = F.filter(F.array(F.when(F.col(x).isNull(), 1), F.when(F.col(y).isNull(), 2)), lambda t: t.isNotNull())
        b = F.array(F.coalesce(F.col(x), F.lit(0)).cast("long"), F.coalesce(F.col(y), F.lit(0)).cast("long"))
        return gens.filter(F.col("kind") == kind).select(doc, "gen", F.struct(b.alias("b"), free.alias("tau")).alias("g"))

    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("gen", c))), lambda t: t[c])
    ups, downs = side("up", "lo_x", "lo_y"), side("down", "hi_x", "hi_y")
    pairs = downs.select("one", F.col("gen").alias("down")).join(ups.select("one", F.col("gen").alias("up")), "one")  # the dense matrix itself
    cells = pairs.join(phi.select("down", "up", _exact(F.col("num"), F.col("den")).alias("v")), ["down", "up"], "left").select("one", "down", F.col("up").alias("gen"), F.coalesce("v", F.lit("0")).alias("v"))
    rows = cells.groupBy("one", "down").agg(in_order("v").alias("v")).select("one", F.col("down").alias("gen"), "v").groupBy("one").agg(in_order("v").alias("phi"))
    whole = ups.groupBy("one").agg(in_order("g").alias("flats")).join(downs.groupBy("one").agg(in_order("g").alias("injectives")), "one").join(rows, "one")
    head = [F.lit("FlangeZn").alias("kind"), F.lit(2).alias("n"), F.struct(F.lit("qq").alias("kind")).alias("coeff_field")]
    whole.select(F.to_json(F.struct(*head, "flats", "injectives", "phi")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_flange_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(gens, phi) of a two-parameter flange document; generators are numbered from 0, zeros of phi are left out."""
    side = "array<struct<b: array<bigint>, tau: array<int>>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"kind string, n int, flats {side}, injectives {side}, phi array<array<string>>").alias("d")).select("d.*")
    kind = text.first()
    if kind is None or kind["kind"] != "FlangeZn" or kind["n"] != 2:
        raise ValueError(f"{path} isn't a flange of two parameters")

    def gens(column: str, kind: str) -> DataFrame:
        rows = text.select(F.posexplode(column).alias("gen", "g"))
        at = lambda k: F.when(~F.array_contains("g.tau", k + 1), F.col("g.b")[k])
        low = [at(0), at(1)] if kind == "up" else [F.lit(None).cast("long")] * 2
        high = [at(0), at(1)] if kind == "down" else [F.lit(None).cast("long")] * 2
        return rows.select("gen", F.lit(kind).alias("kind"), *(c.alias(n) for c, n in zip(low + high, ("lo_x", "lo_y", "hi_x", "hi_y"), strict=True)))

    cells = text.select(F.posexplode("phi").alias("down", "row")).select("down", F.posexplode("row").alias("up", "v"))
    part = F.split("v", "/")
    phi = cells.select("down", "up", part[0].cast("long").alias("num"), F.coalesce(F.get(part, F.lit(1)).cast("long"), F.lit(1).cast("long")).alias("den"))
    return gens("flats", "up").unionByName(gens("injectives", "down")), phi.filter("num <> 0")


def save_features_npz(df: DataFrame, path: str, id_column: str = "id") -> None:
    """A feature table as one file of arrays: ``X`` (rows by features), ``names``, ``ids``; rows go through Arrow to the driver's file.

    The format is one file written by one process; tables beyond its memory belong in Parquet.
    """
    import numpy as np

    names = [c for c in df.columns if c != id_column]
    table = df.orderBy(id_column).toPandas()
    np.savez(path, X=table[names].to_numpy(float), names=np.array(names, dtype=str), ids=table[id_column].astype(str).to_numpy(dtype=str))


def load_features_npz(spark: SparkSession, path: str, id_column: str = "id") -> DataFrame:
    import numpy as np

    with np.load(path, allow_pickle=False) as held:
        table = pd.DataFrame(held["X"], columns=list(map(str, held["names"])))
        table.insert(0, id_column, held["ids"].astype(str))
    return spark.createDataFrame(table)
