"""A stream of measurements to daily means: event time, a watermark for late rows, append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_means(stream: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", late: str = "2 days") -> DataFrame:
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(*keys, F.window(ts, "1 day")).agg(F.avg(value).alias("value"), F.count(value).alias("n")).select(*keys, F.to_date("window.start").alias("day"), "value", "n")
