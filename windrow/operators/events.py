"""Events against stations and slices: overlap, catalogue merge, impact; and day-weighted merging of slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions import geo as G
from windrow.functions import scalars as S
from windrow.operators import nearby as N
from windrow.operators.temporal import circular_mean


def overlapping(events: DataFrame, start: str, end: str) -> DataFrame:
    return events.where((F.col("end_day") >= F.lit(start).cast("date")) & (F.col("start_day") <= F.lit(end).cast("date")))


def merged_catalogue(curated: DataFrame, fetched: DataFrame, days: int = 5, km: float = 35.0) -> DataFrame:
    """Curated events (event_id, kind, start_day, lat, lng, ..) and those fetched ones that aren't fires near a curated fire in
    time and place. Fires meet by boxes of space. Fetched events have different ids."""
    at = ["_x", "_y", "_z"]
    placed = lambda df, *own: df.where("kind = 'fire'").select(*own, *[x.alias(n) for x, n in zip(N.globe(), at, strict=True)])
    known = placed(curated, F.col("start_day").alias("_day"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    pairs = N.within(placed(fetched, "event_id", "start_day", "lat", "lng"), known, at, 1000 * km)
    near = (F.abs(F.datediff("start_day", "_day")) <= days) & (G.haversine_m("lat", "lng", "_lat", "_lng") <= 1000 * km)
    return curated.unionByName(fetched.join(pairs.where(near).select("event_id").distinct(), "event_id", "left_anti").select(*curated.columns))


def impact(events: DataFrame, stations: DataFrame, daily: DataFrame, meteo: DataFrame) -> DataFrame:
    """Each event and station: distance, alignment with the wind, means before, during, after and in the same month of
    other years, and whether the station is exposed. Without wind the transport direction is 180 degrees."""
    e, s = events.alias("e"), stations.alias("s")
    pairs = e.join(s).select("e.event_id", "e.start_day", "e.end_day", "e.radius_km", F.col("s.id").alias("station"), (G.haversine_m("e.lat", "e.lng", "s.lat", "s.lng") / 1000).alias("distance_km"), G.bearing("e.lat", "e.lng", "s.lat", "s.lng").alias("bearing"))
    span = lambda role, first, last: events.select("event_id", F.lit(role).alias("role"), F.explode(F.sequence(first, last)).alias("day"))
    during = span("during", F.col("start_day"), F.col("end_day"))
    wind = meteo.join(during, "day").groupBy("event_id", "station").agg(circular_mean("wind_dir").alias("wind"))
    # events meet the daily values by day, and for the baseline by month: no event is compared with every row
    windows = during.unionByName(span("before", F.date_sub("start_day", 7), F.date_sub("start_day", 1))).unionByName(span("after", F.date_add("end_day", 4), F.date_add("end_day", 14)))
    mean = lambda role: F.avg(F.when(F.col("role") == role, F.col("value"))).alias(f"{role}_mean")
    means = daily.join(windows, "day").groupBy("event_id", "station").agg(*[mean(r) for r in ("before", "during", "after")])
    monthly = daily.groupBy("station", F.year("day").alias("year"), F.month("day").alias("month")).agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    base = monthly.join(events.select("event_id", F.month("start_day").alias("month"), F.year("start_day").alias("own")), "month").where("year <> own")
    base = base.groupBy("event_id", "station").agg((F.sum("total") / F.sum("n")).alias("baseline_mean"))
    means = means.join(base, ["event_id", "station"], "full")
    out = pairs.join(wind, ["event_id", "station"], "left").join(means, ["event_id", "station"], "left")
    towards = F.pmod(F.coalesce("wind", F.lit(0.0)) + 180, F.lit(360.0))
    aligned = F.cos(F.radians(G.angular_difference(towards, F.col("bearing"))))
    out = out.withColumn("alignment", aligned).withColumn("status", F.when((F.col("distance_km") <= 5 * F.col("radius_km")) & (F.col("alignment") > 0.15), "exposed").otherwise("control"))
    return out.select("event_id", "station", "distance_km", "alignment", "status", "before_mean", "during_mean", "after_mean", "baseline_mean", (F.col("during_mean") - F.col("baseline_mean")).alias("delta"))


def day_weighted(slices: DataFrame, keys: list[str], measures: list[str], start: str | Column, end: str | Column) -> DataFrame:
    """Slices (start_day, end_day, measures) merged over a range: means weighted by the days in it, each measure by the
    days of the slices that have it."""
    w = S.overlap_days("start_day", "end_day", *[(x if isinstance(x, Column) else F.lit(x)).cast("date") for x in (start, end)])
    own = slices.withColumn("_w", w).where("_w > 0")
    sums = [F.try_divide(F.sum(F.col(m) * F.col("_w")), F.sum(F.when(F.col(m).isNotNull(), F.col("_w")))).alias(m) for m in measures]
    return own.groupBy(*keys).agg(*sums, F.sum("_w").cast("long").alias("days"), F.count(F.lit(1)).alias("slices"))


def top(rows: DataFrame, keys: list[str], column: str, n: int, tie: str, ascending: bool = False) -> DataFrame:
    """The n highest (or lowest) rows of each group that have a value; ties by id."""
    from pyspark.sql import Window

    order = F.col(column).asc() if ascending else F.col(column).desc()
    ranked = rows.where(F.col(column).isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order, tie)))
    return ranked.where(F.col("rank") <= n)
