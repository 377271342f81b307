"""Cutting lineage between the rounds of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="sparkstrata-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again.

    A checkpoint would keep the constraints that the planner has inferred, and they double with every round of an
    iteration; a table read from files has none.
    """
    path = f"{shared_dir(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """``rows`` with their place from 1 in the order of the given columns, which tell all rows apart.

    Rows are sorted in ranges and written, so that ranges don't move; a range's first place is the sum of the counts
    before it. Only one row a range is seen by one task.
    """
    parts = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(base), "_part").withColumn(name, (place + F.col("_base")).cast("long")).drop("_part", "_base")  # a row a range
