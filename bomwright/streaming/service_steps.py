"""Service steps as a stream: counts and cost of each kind of service in windows of time. An extension; the tables are the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import exact_sum
from ..functions.scalars import is_secondary


def windowed(steps: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Services by type in tumbling windows of begin_at; steps later than ``late`` are dropped by the watermark of a stream."""
    timed = steps.withColumn("begin_at", F.col("begin_at").cast("timestamp")).withWatermark("begin_at", late) if steps.isStreaming else steps
    rows = timed.where(is_secondary(F.col("type"))).groupBy(F.window("begin_at", window).alias("w"), "type").agg(F.count("*").alias("n"), exact_sum(F.col("cost")).alias("cost"))
    return rows.select(F.col("w.start").alias("from_at"), F.col("w.end").alias("to_at"), "type", "n", "cost")
