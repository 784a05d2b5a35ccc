"""The hourly series as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_stream(events: DataFrame, time: str = "ts", value: str = "value", late: str = "2 hours") -> DataFrame:
    """(datetime, lmp, n): mean by hour of a streaming or batch table, hours closed once the watermark has passed. Times without zone are taken as the session's."""
    t = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return t.groupBy(F.window(time, "1 hour").alias("w")).agg(F.avg(value).alias("lmp"), F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("datetime"), "lmp", "n")
