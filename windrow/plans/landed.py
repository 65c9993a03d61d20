"""Queries of landed networks' data and of kriging's gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from windrow.operators import grids as B
from windrow.operators import spatial as X
from windrow.plans import catalogue as C
from windrow.plans import views as V
from windrow.plans.catalogue import query, r6
from windrow.sources import networks as N


@query()
def kriging_support(spark, sf):
    return X.kriging_gate(V.geo(spark, sf), ["scope"])


@query("geo", f"with {C.EXTENT_SQL} select i as cell, round(south + (i // 6 + 0.5::double) * (north - south) / 6, 6) as lat, round(west + (i % 6 + 0.5::double) * (east - west) / 6, 6) as lng from x, range(36) t(i)")
def elevation_grid(spark, sf):
    return r6(N.elevation_cells(B.extent(None, V.geo(spark, sf))).drop("ring"))


@query("air", """select 'modeled-' || station as station, pollutant, day, round(avg(v) + 1e-9, 4) as value, 'ug/m3' as unit, 'estimated' as quality_flag
  from (select station, 'PM10' as pollutant, day, value as v from air union all select station, 'O3', day, value / 4 from air where event_id % 3 <> 0) group by station, pollutant, day""")
def modeled_backfill(spark, sf):
    at = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    ozone = F.transform("s", lambda x: F.when(x.event_id % 3 != 0, x.value / 4))
    hourly = F.struct(F.transform("s", lambda x: F.date_format(x.ts, "yyyy-MM-dd'T'HH:mm")).alias("time"), F.col("s.value").alias("pm10"), ozone.alias("ozone"), *[F.lit(None).cast("array<double>").alias(c) for c in ("pm2_5", "nitrogen_dioxide", "sulphur_dioxide")])
    days = V.air(spark, sf).groupBy("station", "day").agg(at.alias("s"))  # a day's hours of a station make a series
    return N.backfill(days.select(F.col("station").cast("string").alias("station"), hourly.alias("hourly")))
