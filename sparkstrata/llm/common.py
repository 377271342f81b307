"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handed to one numpy pass; bounds what a Python worker holds beside its Arrow batch.
ROWS_PER_PASS = 128


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="sparkstrata-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Rows of a few numbers that one task writes at least, where a table's size is known; tasks for the smallest table.
ROWS_PER_FILE, LEAST_FILES = 50_000, 8


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage is cut and no executor's disk is needed later.

    ``rows``: about so many are expected at most, so a small table isn't dealt to as many files as there are shuffle
    partitions. Without Hadoop's native library a local file costs three forks of the executor (chmod of folder, file
    and checksum). Only the last stage gets fewer tasks, so it has to be one of sums or distinct rows.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // ROWS_PER_FILE)))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with so many underscores that no column of ``df`` has it (names count without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_PER_PASS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def let(value: Column, body) -> Column:
    """``body`` of ``value`` evaluated once: a lambda variable is bound, so the planner can't repeat the expression."""
    return F.transform(F.array(value), body)[0]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, *, slope: float = 1.0, offset: float = 0.0) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit (Newton steps, small ridge); targets are drawn in from 0 and 1."""
    w = np.ones(len(y)) if weight is None else weight
    y = np.clip(y, 0.5 / len(y), 1 - 0.5 / len(y))
    a, b = slope, offset
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        v = w * p * (1 - p) + 1e-9
        grad = np.array([(w * (p - y) * x).sum() + 1e-3 * a, (w * (p - y)).sum() + 1e-3 * b])
        hess = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


#: Bits of the sieve below; its size is fixed, so it may be broadcast whatever the table's size.
SIEVE_BITS = 1 << 24


def sieve_of(nodes: DataFrame, column: str = "node") -> np.ndarray:
    """A bitmap of the residues that a long column takes; lets a scan leave out most rows that an exact join would drop.

    At most ``SIEVE_BITS / 8`` bytes reach the driver. When it fills up with the data it only passes more rows.
    """
    at = (F.pmod(F.col(column), F.lit(SIEVE_BITS)) + 1).alias("at")
    parts = nodes.select(at).groupBy(F.expr("bitmap_bucket_number(at)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits")).collect()
    out = np.zeros((SIEVE_BITS // 32768, 32768), bool)
    for r in parts:
        out[r["k"] - 1] = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
    return np.packbits(out.ravel())


def passes(sieve: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    at = np.mod(nodes, SIEVE_BITS)
    return (sieve[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
