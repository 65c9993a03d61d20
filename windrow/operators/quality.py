"""Records: dedupe, two-stage means, completeness and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.functions import scalars as S


def deduplicated(records: DataFrame, keys: list[str], ordinal: str, value: str = "value") -> DataFrame:
    """One row per key: single rows as they are; of several the mean (4 digits), flagged `screened`, with the other
    fields of the last one in order of `ordinal`."""
    rest = [c for c in records.columns if c not in (*keys, value, "quality_flag")]
    grouped = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_mean"), F.max_by(F.struct(value, "quality_flag", *rest), ordinal).alias("_last"))
    several = F.col("_n") > 1
    return grouped.select(*keys, F.when(several, F.round("_mean", 4)).otherwise(F.col(f"_last.{value}")).alias(value), F.when(several, "screened").otherwise(F.col("_last.quality_flag")).alias("quality_flag"), *[F.col(f"_last.{c}").alias(c) for c in rest])


def mean_of_means(records: DataFrame, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Hourly means, then the mean of a day's hours, so that an hour with many samples weighs as much as another."""
    hours = records.where(F.col(value) >= 0).groupBy(*keys, F.date_trunc("hour", ts).alias("hour")).agg(F.avg(value).alias("m"))
    return hours.groupBy(*keys, F.to_date("hour").alias("day")).agg(S.rounded(F.avg("m")).alias("value"), F.count(F.lit(1)).alias("hours"))


def completeness(days: DataFrame, keys: list[str], expected: int, day: str = "day") -> DataFrame:
    """Days with data against days expected."""
    actual = F.countDistinct(day)
    return days.groupBy(*keys).agg(actual.alias("actual"), F.lit(expected).cast("long").alias("expected"), F.round(actual / F.lit(expected), 4).alias("ratio"), F.greatest(F.lit(expected) - actual, F.lit(0)).cast("long").alias("missing"))


def completeness_overview(rows: DataFrame, by: str, warn_below: float = 0.75) -> DataFrame:
    out = rows.groupBy(by).agg(F.sum("actual").alias("actual"), F.sum("expected").alias("expected"), F.count(F.lit(1)).alias("series"))
    ratio = F.round(F.col("actual") / F.col("expected"), 4)
    return out.withColumn("ratio", ratio).withColumn("warning", ratio < warn_below)


def window_summary(daily: DataFrame, keys: list[str], threshold: float, days: int, value: str = "value") -> DataFrame:
    """Of each station in a window: mean, share of days over the threshold, completeness."""
    over = F.avg((F.col(value) > threshold).cast("double"))
    return daily.groupBy(*keys).agg(F.avg(value).alias("mean"), over.alias("exceedance_ratio"), F.least(F.lit(1.0), F.count(F.lit(1)) / F.lit(float(days))).alias("completeness"))


def gated(summary: DataFrame, by: list[str], min_stations: int, min_completeness: float = 0.7) -> DataFrame:
    """ok, or which gate refuses: too few stations first, then too little data."""
    out = summary.groupBy(*by).agg(F.count(F.lit(1)).alias("stations"), F.avg("completeness").alias("completeness"))
    status = F.when(F.col("stations") < min_stations, "insufficient-stations").when(F.col("completeness") < min_completeness, "insufficient-completeness").otherwise("ok")
    return out.withColumn("status", status)


def first_met(rows: DataFrame, keys: list[str], place: str = "place") -> DataFrame:
    """Of the rows of each key the one that stands first, by their place in the input (`readers.place`, or any order)."""
    rest = [c for c in rows.columns if c not in keys and c != place]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), place).alias("_first"))
    return best.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])
