"""Short forecasts of daily series: gap fill, seasonal-naive, damped trend, their mean, and a hold-out test."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PHI = 0.82


def filled(daily: DataFrame, keys: list[str], day: str = "day", value: str = "value") -> DataFrame:
    """Every calendar day between a series' ends, missing values on the line between their neighbours."""
    days = daily.groupBy(*keys).agg(F.explode(F.sequence(F.min(day), F.max(day))).alias(day))
    full = days.join(daily.select(*keys, day, F.col(value).alias("v")), [*keys, day], "left")
    back = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(day).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("v").isNotNull(), F.struct(F.col(day).alias("d"), F.col("v").alias("v")))
    p, q = F.last(known, True).over(back), F.first(known, True).over(ahead)
    both = full.withColumn("p", p).withColumn("q", q)
    gap = F.datediff("q.d", "p.d")
    line = F.col("p.v") + (F.col("q.v") - F.col("p.v")) * F.try_divide(F.datediff(day, F.col("p.d")), F.nullif(gap, F.lit(0)))
    return both.select(*keys, day, F.coalesce("v", line, "p.v", "q.v").alias(value), F.col("v").isNotNull().alias("observed"))


def forecasts(series: DataFrame, keys: list[str], horizon: int, day: str = "day", value: str = "value") -> DataFrame:
    """(keys, h, day, naive, damped, value) of the days after each series' last: the last week repeated, a damped line from
    the slope of the last 28 days, and their mean."""
    w = Window.partitionBy(*keys).orderBy(F.col(day).desc())
    last = series.withColumn("r", F.row_number().over(w)).where("r <= 28")
    agg = last.groupBy(*keys).agg(F.max(day).alias("end"), F.max_by(value, day).alias("last"), F.coalesce(F.regr_slope(F.col(value), -F.col("r").cast("double")), F.lit(0.0)).alias("slope"), F.map_from_entries(F.collect_list(F.when(F.col("r") <= 7, F.struct("r", value)))).alias("week"))
    steps = agg.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    naive = F.coalesce(F.element_at("week", 7 - F.pmod(F.col("h") - 1, F.lit(7))), F.col("last"))
    damped = F.col("last") + F.col("slope") * (1 - F.pow(F.lit(PHI), "h")) / (1 - PHI)
    return steps.select(*keys, "h", F.date_add("end", F.col("h")).alias(day), naive.alias("naive"), damped.alias("damped"), ((naive + damped) / 2).alias(value))


def backtest(series: DataFrame, keys: list[str], horizon: int, day: str = "day", value: str = "value") -> DataFrame:
    """MAE and RMSE of the forecast of each series' last `horizon` days from those before."""
    marked = series.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(day).desc())))
    guess = forecasts(marked.where(F.col("_r") > horizon).drop("_r"), keys, horizon, day, value).select(*keys, day, F.col(value).alias("guess"))
    error = marked.where(F.col("_r") <= horizon).join(guess, [*keys, day]).withColumn("e", F.col(value) - F.col("guess"))
    return error.groupBy(*keys).agg(F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.count(F.lit(1)).alias("n"))


def gated_forecasts(series: DataFrame, keys: list[str], horizon: int, day: str = "day", value: str = "value", observed: str = "observed") -> DataFrame:
    """Forecasts with a band of 1.64 RMSE for series that are long and observed enough (max(90, 3 h) days, three quarters)."""
    ok = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(observed).cast("double")).alias("ratio")).where((F.col("n") >= max(90, 3 * horizon)) & (F.col("ratio") >= 0.75))
    good = series.join(ok.select(*keys), keys, "left_semi")
    out = forecasts(good, keys, horizon, day, value).join(backtest(good, keys, horizon, day, value).select(*keys, "rmse"), keys)
    return out.select(*keys, "h", day, value, (F.col(value) - 1.64 * F.col("rmse")).alias("low"), (F.col(value) + 1.64 * F.col("rmse")).alias("high"))
