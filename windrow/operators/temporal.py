"""Series operators: buckets, trends, change points, episodes, decomposition, comparisons.

Series are long tables: any number of them at once, told apart by key columns, so that each statistic is one grouped job."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions import scalars as S


def bucket_mean(records: DataFrame, keys: list[str], resolution: str, day: str = "day", value: str = "value") -> DataFrame:
    """Mean, count and first day of all records in each day, month, season or year."""
    key, label = S.bucket(day, resolution)
    return records.groupBy(*keys, key.alias("bucket"), label.alias("label")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.min(day).alias("first_day"))


def rises(values: np.ndarray) -> tuple[int, int]:
    """Pairs of an earlier and a later value of which the later one is greater, and smaller: counted while sorted runs are
    merged, in time of n log^2 n."""
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    at, up, down, width = np.arange(n), 0, 0, 1
    while width < n:
        pair = at // (2 * width)
        right = at // width % 2 == 1
        key = pair * (n + 1) + rank  # places are sorted by rank within each run
        left = key[~right]
        later = key[right]
        lower = np.searchsorted(left, later, "left") - np.searchsorted(left, later // (n + 1) * (n + 1), "left")
        whole = np.searchsorted(left, (later // (n + 1) + 1) * (n + 1), "left") - np.searchsorted(left, later // (n + 1) * (n + 1), "left")
        same = np.searchsorted(left, later, "right") - np.searchsorted(left, later, "left")
        up += int(lower.sum())
        down += int((whole - lower - same).sum())
        order = np.lexsort((rank, pair))
        rank, width = rank[order], 2 * width
    return up, down


def _nth_slope(v: np.ndarray, k: int) -> float:
    """The k-th smallest slope, from 1, among all pairs of points (0, v[0]), (1, v[1]), ..: slopes under a bound are counted as
    falls of what is left of the values above a line of that slope, and the bound is halved in."""
    x = np.arange(len(v))
    steps = np.abs(np.diff(v)).max()
    lo, hi = -steps - 1, steps + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        if not lo < mid < hi:
            break
        rest = v - mid * x
        total, (up, _) = len(v) * (len(v) - 1) // 2, rises(rest)
        if total - up >= k:  # pairs that do not rise have slopes up to mid
            hi = mid
        else:
            lo = mid
    order = np.lexsort((x, v - hi * x))  # the pair of that slope lies side by side
    i, j = order[:-1], order[1:]
    slopes = (v[j] - v[i]) / (j - i)
    return float(slopes[np.abs(slopes - hi).argmin()])


def median_slope(v: np.ndarray) -> float:
    """Theil and Sen's slope of points at equal steps, without a list of all pairs."""
    m = len(v) * (len(v) - 1) // 2
    lower = _nth_slope(v, (m + 1) // 2)
    return lower if m % 2 else (lower + _nth_slope(v, m // 2 + 1)) / 2


def mann_kendall(series: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """S, tau, two-sided p, Theil-Sen slope and direction of each series; stable under four points. Missing values don't count.

    A series is one group: what it holds grows with its points, not with their pairs (see `rises`, `median_slope`). It is
    bucketed (months, days) before, so that its points are bounded by the calendar."""

    def trend(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)["v"].to_numpy(float)
        n = len(v)
        up, down = rises(v) if n >= 4 else (0, 0)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "n": float(n), "s": float(up - down), "m": n * (n - 1) / 2, "slope": median_slope(v) if n >= 4 else 0.0}])

    rows = series.select(*keys, order, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    types = dict(series.dtypes)
    out = rows.groupBy(*keys).applyInPandas(trend, ", ".join([*[f"`{k}` {types[k]}" for k in keys], "n double, s double, m double, slope double"]))
    z = S.continuity_z("s", F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) / 18)
    few = F.col("n") < 4
    p = F.when(few, 1.0).otherwise(S.two_sided_p(z))
    direction = F.when(p >= 0.05, "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    return out.select(*keys, F.when(few, 0.0).otherwise(F.col("s") / F.col("m")).alias("tau"), p.alias("p_value"), "slope", direction.alias("direction"))


def seasonal_kendall(series: DataFrame, keys: list[str], month: str = "month", value: str = "value") -> DataFrame:
    """Kendall's S summed over calendar months, slopes a year; month is a date."""
    n = series.select(*keys, F.month(month).alias("season"), F.year(month).alias("year"), F.col(value).alias("v"))
    a, b, at = n.alias("a"), n.alias("b"), [*keys, "season"]
    pairs = a.join(b, [*[F.col(f"a.{k}") == F.col(f"b.{k}") for k in at], F.col("a.year") < F.col("b.year")])
    made = pairs.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.signum(F.col("b.v") - F.col("a.v")).alias("sign"), ((F.col("b.v") - F.col("a.v")) / (F.col("b.year") - F.col("a.year"))).alias("slope"))
    sums = made.groupBy(*keys).agg(F.sum("sign").alias("s"), F.median("slope").alias("slope"), F.count(F.lit(1)).alias("pairs"))
    per = n.groupBy(*at).agg(F.count(F.lit(1)).cast("double").alias("n")).where("n >= 2")
    variance = per.groupBy(*keys).agg(F.sum(F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) / 18).alias("variance"), F.count(F.lit(1)).alias("season_count"))
    out = sums.join(variance, keys)
    p = S.two_sided_p(S.continuity_z("s", "variance"))
    direction = F.when((p >= 0.05) | (F.col("slope") == 0), "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    return out.select(*keys, (F.col("s") / F.col("pairs")).alias("tau"), p.alias("p_value"), F.col("slope").alias("slope_per_year"), direction.alias("direction"), "season_count")


def change_point(series: DataFrame, keys: list[str], month: str = "month", value: str = "value") -> DataFrame:
    """(keys, break_at, score, mean_shift, direction): the first largest CUSUM of residuals from the calendar month's mean,
    scaled by their standard deviation.

    Every series has a row. Under 6 months its score is 0; without a break (score under 1, or the break at its start) it is
    stable without a shift; a shift under 0.1 is stable too."""
    by = Window.partitionBy(*keys)
    clim = series.withColumn("r", F.col(value) - F.avg(value).over(Window.partitionBy(*keys, F.month(month))))
    sigma = F.coalesce(F.nullif(F.stddev_samp("r").over(by), F.lit(0.0)), F.lit(1.0))
    steps = clim.withColumn("step", F.col("r") / sigma).withColumn("i", F.row_number().over(by.orderBy(month)) - 1)
    run = steps.withColumn("c", F.round(F.abs(F.sum("step").over(by.orderBy(month).rowsBetween(Window.unboundedPreceding, 0))), 9))
    best = run.groupBy(*keys).agg(F.max_by(F.struct("i", month), F.struct("c", -F.col("i"))).alias("at"), F.max("c").alias("score"), F.count(F.lit(1)).alias("n"))
    long, broken = F.col("n") >= 6, (F.col("n") >= 6) & (F.col("at.i") > 0) & (F.col("score") >= 1)
    found = best.select(*keys, F.when(broken, F.col(f"at.{month}")).alias("break_at"), F.when(long, F.floor(F.col("score") * 100 + 0.5) / 100).otherwise(0.0).alias("score"))
    shift = series.join(found, keys)
    before = F.avg(F.when(F.col(month) < F.col("break_at"), F.col(value)))
    after = F.avg(F.when(F.col(month) >= F.col("break_at"), F.col(value)))
    out = shift.groupBy(*keys, "break_at", "score").agg((after - before).alias("mean_shift"))
    return out.withColumn("direction", F.when(F.col("mean_shift") >= 0.1, "upward").when(F.col("mean_shift") <= -0.1, "downward").otherwise("stable"))


def episodes(daily: DataFrame, keys: list[str], threshold: Column | float, day: str = "day", value: str = "value") -> DataFrame:
    """Runs of consecutive calendar days over a threshold: their number, the longest, the one that runs at the end."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    last = daily.groupBy(*keys).agg(F.max(day).alias("last_day"))
    over = daily.where(F.col(value) > limit).withColumn("island", F.date_sub(day, F.row_number().over(Window.partitionBy(*keys).orderBy(day))))
    runs = over.groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("days"), F.max(day).alias("to_day"))
    per = last.join(runs, keys, "left").groupBy(*keys)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return per.agg(zero(F.sum("days")).alias("exceedance_days"), F.count("days").alias("episode_count"), zero(F.max("days")).alias("longest"), zero(F.max(F.when(F.col("to_day") == F.col("last_day"), F.col("days")))).alias("current"))


def moving_average(series: DataFrame, keys: list[str], order: str, width: int = 5, passes: int = 1, value: str = "value", into: str = "smooth") -> DataFrame:
    """The Kolmogorov-Zurbenko filter: a centred mean, shorter at the ends, some times over."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width // 2), width // 2)
    out = series.withColumn(into, F.col(value))
    for _ in range(passes):
        out = out.withColumn(into, F.avg(into).over(w))
    return out


def kz_decomposition(series: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """Shares of the variance in the KZ(5, 2) baseline and in what is left, its change, and the rest's deviation."""
    kz = moving_average(series, keys, order, 5, 2, value).withColumn("rest", F.col(value) - F.col("smooth"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    agg = kz.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), zero(F.var_samp(value)).alias("v"), zero(F.var_samp("smooth")).alias("b"), zero(F.var_samp("rest")).alias("r"), (F.max_by("smooth", order) - F.min_by("smooth", order)).alias("change"))
    total, ok = F.coalesce(F.nullif("v", F.lit(0.0)), F.lit(1.0)), F.col("n") >= 5
    share = lambda c: F.when(ok, F.least(F.lit(1.0), F.col(c) / total)).otherwise(0.0)
    return agg.select(*keys, share("b").alias("background_share"), share("r").alias("residual_share"), F.when(ok, F.col("change")).otherwise(0.0).alias("baseline_change"), F.when(ok, F.sqrt("r")).otherwise(0.0).alias("residual_std"))


def monthly_zscore(series: DataFrame, keys: list[str], month: str = "month", value: str = "value") -> DataFrame:
    """Each value against the mean and deviation of its calendar month over the whole history; 0 without deviation."""
    w = Window.partitionBy(*keys, F.month(month))
    sd = F.nullif(F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0)), F.lit(0.0))
    return series.withColumn("z", F.coalesce((F.col(value) - F.avg(value).over(w)) / sd, F.lit(0.0)))


def latest(series: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each series."""
    ranked = series.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc())))
    return ranked.where(F.col("_r") <= n).drop("_r")


def same_month(series: DataFrame, keys: list[str], month: str = "month") -> DataFrame:
    """Of each series the rows of its last row's calendar month, in every year."""
    last = F.month(F.max(month).over(Window.partitionBy(*keys)))
    return series.withColumn("_m", last).where(F.month(month) == F.col("_m")).drop("_m")


def weekday_weekend(daily: DataFrame, keys: list[str], day: str = "day", value: str = "value") -> DataFrame:
    weekend = F.dayofweek(day).isin(1, 7)
    side = lambda c: F.coalesce(F.avg(F.when(c, F.col(value))), F.lit(0.0))
    return daily.groupBy(*keys).agg(side(~weekend).alias("weekday_mean"), side(weekend).alias("weekend_mean")).withColumn("difference", F.col("weekday_mean") - F.col("weekend_mean"))


def pearson(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Correlation by group; 0 with under two pairs or without variance on either side."""
    root = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return pairs.groupBy(*keys).agg(F.coalesce(F.try_divide(F.covar_pop(x, y), F.nullif(root, F.lit(0.0))), F.lit(0.0)).alias("r"), F.count(F.lit(1)).alias("n"))


def circular_mean(angle: Column | str) -> Column:
    """Mean direction in degrees; null without any."""
    a = F.radians(S.col(angle))
    return F.pmod(F.degrees(F.atan2(F.sum(F.sin(a)), F.sum(F.cos(a)))), F.lit(360.0))
