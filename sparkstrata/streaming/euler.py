"""The Euler measure of a stream: a sum of signs, so windows merge and late rows only add.

Rows are cells with an event time, a dimension and grid indices. In append mode a window is given out once the
watermark has passed its end; rows that are later than that are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import sign


def event_cells(events: DataFrame, step: float) -> DataFrame:
    """``ts, dim, i, j``: each event is a vertex; errors are read as edges (they join two states). Grades: value index, kind."""
    ts = F.col("ts").cast("timestamp").alias("ts") if events.isStreaming else F.col("ts")  # watermarks need a zoned type
    return events.select(ts, F.when(F.col("event_type") == "error", 1).otherwise(0).alias("dim"), F.floor(F.col("value") / step).cast("long").alias("i"), F.length("event_type").cast("long").alias("j"))


def windowed_measure(cells: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, i, j, w``; works on batch and streaming tables alike."""
    rows = cells.withWatermark("ts", late) if cells.isStreaming else cells
    sums = rows.groupBy(F.window("ts", window).alias("win"), "i", "j").agg(F.sum(sign(F.col("dim"))).alias("w"))
    return sums.select(F.col("win.start").alias("start"), "i", "j", "w")
