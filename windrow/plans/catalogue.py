"""Queries by name over the views, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.functions import geo as G
from windrow.functions import scalars as S
from windrow.operators import events as E
from windrow.operators import forecast as P
from windrow.operators import grids as B
from windrow.operators import nearby as N
from windrow.operators import quality as Q
from windrow.operators import spatial as X
from windrow.operators import temporal as T
from windrow.plans import views as V
from windrow.sources import landed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(views: str = "", sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = V.nudged(V.with_views(views, sql) if views else sql)
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    """Doubles to 6 digits, so that the order of a sum doesn't show."""
    return df.select(*[S.rounded(c).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


# buckets and filters -------------------------------------------------------------------------------------------------
SEASON_SQL = "case when month(day) = 12 then year(day) + 1 else year(day) end"
for _resolution, _view, _key, _label in (
    ("day", "air", "strftime(day, '%Y-%m-%d')", None),
    ("month", "air_long", "strftime(day, '%Y-%m')", None),
    ("year", "air_long", "strftime(day, '%Y')", None),
    ("season", "air_long", f"({SEASON_SQL}) || '-' || ((month(day) % 12) // 3)", f"(['Kış', 'İlkbahar', 'Yaz', 'Sonbahar'])[(month(day) % 12) // 3 + 1] || ' ' || ({SEASON_SQL})"),
):

    def _bucket(spark, sf, resolution=_resolution, view=_view):
        return r6(T.bucket_mean(getattr(V, view)(spark, sf), ["pollutant"], resolution))

    query(_view, f"select pollutant, {_key} as bucket, {_label or _key} as label, round(avg(value), 6) as mean, count(value) as n, min(day) as first_day from {_view} group by all", f"bucket_mean_{_resolution}")(_bucket)


@query("air", "select station, pollutant, day, count(*) as n, round(avg(value), 6) as mean from air where station % 4 in (0, 1) and pollutant = 'purchase' group by all")
def filter_scope_pollutant(spark, sf):
    a = V.air(spark, sf).where((F.col("station") % 4).isin(0, 1) & (F.col("pollutant") == "purchase"))
    return r6(a.groupBy("station", "pollutant", "day").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


@query("air", "select station, pollutant, count(*) as n, round(sum(value), 6) as total from air where day between date '2024-01-08' and date '2024-01-21' group by all")
def filter_date_range(spark, sf):
    a = V.air(spark, sf).where(F.col("day").between(F.lit("2024-01-08").cast("date"), F.lit("2024-01-21").cast("date")))
    return r6(a.groupBy("station", "pollutant").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


# records -------------------------------------------------------------------------------------------------------------
@query("air", """select station, pollutant, day, case when count(*) > 1 then round(avg(value), 4) else arg_max(value, event_id) end as value,
  case when count(*) > 1 then 'screened' else 'valid' end as quality_flag, arg_max(event_id, event_id) as event_id from air group by all""")
def dedupe_records(spark, sf):
    a = V.air(spark, sf).select("station", "pollutant", "day", "value", F.lit("valid").alias("quality_flag"), "event_id")
    return Q.deduplicated(a.withColumn("ord", F.col("event_id")), ["station", "pollutant", "day"], "ord").drop("ord")


@query("air", """select station, pollutant, hour::date as day, round(avg(m), 6) as value, count(*) as hours from
  (select station, pollutant, date_trunc('hour', ts) as hour, avg(value) as m from air where value >= 0 group by all) group by all""")
def hour_day_mean_of_means(spark, sf):
    return Q.mean_of_means(V.air(spark, sf), ["station", "pollutant"])


@query("daily", "select station, pollutant, count(distinct day) as actual, 30::bigint as expected, round(count(distinct day) / 30.0::double, 4) as ratio, greatest(30 - count(distinct day), 0)::bigint as missing from daily group by all")
def completeness_rows(spark, sf):
    return Q.completeness(V.daily(spark, sf), ["station", "pollutant"], 30)


@query("daily", """select pollutant, sum(actual)::bigint as actual, (30 * count(*))::bigint as expected, count(*) as series, round(sum(actual) / (30 * count(*))::double, 4) as ratio,
  round(sum(actual) / (30 * count(*))::double, 4) < 0.75 as warning from (select station, pollutant, count(distinct day) as actual from daily group by all) group by all""")
def completeness_overview(spark, sf):
    return Q.completeness_overview(completeness_rows(spark, sf), "pollutant")


@query("daily", "select * from (select station, pollutant, round(count(distinct day) / 56.0::double, 4) as ratio from daily group by all order by ratio, station, pollutant limit 8) where ratio < 0.55")
def weakest_coverage(spark, sf):
    rows = Q.completeness(V.daily(spark, sf), ["station", "pollutant"], 56)
    return rows.select("station", "pollutant", "ratio").orderBy("ratio", "station", "pollutant").limit(8).where("ratio < 0.55")


@query("daily", """select station, pollutant, round(avg(value), 6) as mean, round(avg((value > 50)::int::double), 6) as exceedance_ratio, round(least(1.0, count(*) / 14.0::double), 6)::double as completeness
  from daily where day between date '2024-01-08' and date '2024-01-21' group by all""")
def station_window_summary(spark, sf):
    d = V.daily(spark, sf).where(F.col("day").between(F.lit("2024-01-08").cast("date"), F.lit("2024-01-21").cast("date")))
    return r6(Q.window_summary(d, ["station", "pollutant"], 50.0, 14))


@query("daily", """with s as (select pollutant, station, least(1.0, count(*) / 14.0::double)::double as c from daily where day between date '2024-01-08' and date '2024-01-21' group by all)
select pollutant, count(*) as stations, round(avg(c), 6) as completeness, case when count(*) < 4 then 'insufficient-stations' when avg(c) < 0.7 then 'insufficient-completeness' else 'ok' end as status from s group by pollutant""")
def quality_gate_status(spark, sf):
    return r6(Q.gated(station_window_summary(spark, sf), ["pollutant"], 4))


@query("air", """with r as (select *, row_number() over (partition by station, pollutant order by ts desc, event_id desc) as r from air)
select station, pollutant, round(avg(value) filter (r <= 16), 6) as current, round(avg(value), 6) as mean from r group by all""")
def station_snapshot_last16(spark, sf):
    a = V.air(spark, sf).withColumn("o", F.struct("ts", "event_id"))
    last = T.latest(a, ["station", "pollutant"], "o", 16).groupBy("station", "pollutant").agg(F.avg("value").alias("current"))
    return r6(last.join(a.groupBy("station", "pollutant").agg(F.avg("value").alias("mean")), ["station", "pollutant"]))


@query("daily", """with w as (select station, pollutant, coalesce(avg(value) filter (dayofweek(day) not in (6, 0)), 0) as a, coalesce(avg(value) filter (dayofweek(day) in (6, 0)), 0) as b from daily group by all)
select station, pollutant, round(a, 6) as weekday_mean, round(b, 6) as weekend_mean, round(a - b, 6) as difference from w""")
def weekday_weekend_diff(spark, sf):
    return r6(T.weekday_weekend(V.daily(spark, sf), ["station", "pollutant"]))


# series --------------------------------------------------------------------------------------------------------------
@query("monthly", "select pollutant, month, value from (select *, row_number() over (partition by pollutant order by month desc) as r from monthly) where r <= 18")
def compare_last_months(spark, sf):
    return T.latest(V.monthly(spark, sf), ["pollutant"], "month", 18)


@query("monthly", "select pollutant, month, value from (select *, max(month) over (partition by pollutant) as last from monthly) where month(month) = month(last)")
def compare_same_month(spark, sf):
    return T.same_month(V.monthly(spark, sf), ["pollutant"])


@query("monthly", """select pollutant, month, value, round(coalesce((value - avg(value) over w) / nullif(stddev_samp(value) over w, 0), 0), 6) as z from monthly window w as (partition by pollutant, month(month))""")
def monthly_zscore(spark, sf):
    return r6(T.monthly_zscore(V.monthly(spark, sf), ["pollutant"]))


CDF = "0.5 * (1 + sign({z}) * (1 - ((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({z}) * ({z}) / 2)))"
P_OF = "2 * (1 - " + CDF.format(z="abs(z)", t="(1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)))") + ")"


@query("monthly", f"""with n as (select *, row_number() over (partition by pollutant order by month) as i from monthly),
p as (select a.pollutant, sign(b.value - a.value) as s, (b.value - a.value) / (b.i - a.i) as slope from n a join n b on a.pollutant = b.pollutant and a.i < b.i),
c as (select pollutant, count(*)::double as n from n group by 1),
g as (select c.pollutant, any_value(n) as n, sum(s) as s, count(*) as m, median(slope) as slope from p join c on p.pollutant = c.pollutant group by 1),
z as (select *, case when s > 0 then (s - 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18) when s < 0 then (s + 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18) else 0 end as z from g),
q as (select *, {P_OF} as p from z)
select pollutant, round(s / m, 6)::double as tau, round(p, 6)::double as p_value, round(slope, 6) as slope, case when p >= 0.05 then 'stable' when slope > 0 then 'increasing' else 'decreasing' end as direction from q""")
def mann_kendall(spark, sf):
    return r6(T.mann_kendall(V.monthly(spark, sf), ["pollutant"], "month"))


@query("network_daily", f"""with n as (select *, row_number() over (partition by pollutant order by day) as i from network_daily),
p as (select a.pollutant, sign(b.value - a.value) as s, (b.value - a.value) / (b.i - a.i) as slope from n a join n b on a.pollutant = b.pollutant and a.i < b.i),
c as (select pollutant, count(*)::double as n from n group by 1),
g as (select c.pollutant, any_value(n) as n, sum(s) as s, count(*) as m, median(slope) as slope from p join c on p.pollutant = c.pollutant group by 1),
z as (select *, case when s > 0 then (s - 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18) when s < 0 then (s + 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18) else 0 end as z from g),
q as (select *, {P_OF} as p from z)
select pollutant, round(s / m, 6)::double as tau, round(p, 6)::double as p_value, round(slope, 6) as slope, case when p >= 0.05 then 'stable' when slope > 0 then 'increasing' else 'decreasing' end as direction from q""")
def mann_kendall_daily(spark, sf):
    return r6(T.mann_kendall(V.network_daily(spark, sf), ["pollutant"], "day"))


@query("monthly", f"""with n as (select pollutant, month(month) as season, year(month) as y, value from monthly),
p as (select a.pollutant, sign(b.value - a.value) as s, (b.value - a.value) / (b.y - a.y) as slope from n a join n b on a.pollutant = b.pollutant and a.season = b.season and a.y < b.y),
v as (select pollutant, sum(n * (n - 1) * (2 * n + 5) / 18) as v, count(*) as k from (select pollutant, season, count(*)::double as n from n group by all having count(*) >= 2) group by pollutant),
g as (select p.pollutant, sum(s) as s, count(*) as m, median(slope) as slope, any_value(v) as v, any_value(k) as k from p join v on p.pollutant = v.pollutant group by 1),
z as (select *, case when s > 0 then (s - 1) / sqrt(v) when s < 0 then (s + 1) / sqrt(v) else 0 end as z from g),
q as (select *, {P_OF} as p from z)
select pollutant, round(s / m, 6)::double as tau, round(p, 6)::double as p_value, round(slope, 6) as slope_per_year, case when p >= 0.05 or slope = 0 then 'stable' when slope > 0 then 'increasing' else 'decreasing' end as direction, k as season_count from q""")
def seasonal_kendall(spark, sf):
    return r6(T.seasonal_kendall(V.monthly(spark, sf), ["pollutant"]))


@query("monthly", """with r as (select *, value - avg(value) over (partition by pollutant, month(month)) as r from monthly),
s as (select *, r / coalesce(nullif(stddev_samp(r) over (partition by pollutant), 0), 1) as step, row_number() over (partition by pollutant order by month) - 1 as i from r),
c as (select *, round(abs(sum(step) over (partition by pollutant order by month rows unbounded preceding)), 9) as c from s),
b as (select pollutant, arg_max(month, (c, -i)) as spot, arg_max(i, (c, -i)) as i, max(c) as most, count(*) as n from c group by 1),
f as (select pollutant, case when n >= 6 and i > 0 and most >= 1 then spot end as break_at, case when n >= 6 then floor(most * 100 + 0.5) / 100 else 0 end::double as score from b),
m as (select f.pollutant, break_at, score, avg(value) filter (month >= break_at) - avg(value) filter (month < break_at) as shift from f join monthly m on f.pollutant = m.pollutant group by all)
select pollutant, break_at, round(score, 6) as score, round(shift, 6) as mean_shift, case when shift is null or abs(shift) < 0.1 then 'stable' when shift > 0 then 'upward' else 'downward' end as direction from m""")
def cusum_change_point(spark, sf):
    return r6(T.change_point(V.monthly(spark, sf), ["pollutant"]))


@query("daily", """with l as (select station, pollutant, max(day) as last from daily group by all),
o as (select station, pollutant, day, day - (row_number() over (partition by station, pollutant order by day))::int as island from daily where value > 50),
r as (select station, pollutant, island, count(*) as days, max(day) as to_day from o group by all)
select l.station, l.pollutant, coalesce(sum(days), 0)::bigint as exceedance_days, count(days) as episode_count, coalesce(max(days), 0)::bigint as longest, coalesce(max(days) filter (to_day = last), 0)::bigint as current
from l left join r on l.station = r.station and l.pollutant = r.pollutant group by l.station, l.pollutant""")
def exceedance_episodes(spark, sf):
    return T.episodes(V.daily(spark, sf), ["station", "pollutant"], 50.0)


KZ = """with a as (select *, avg(value) over (partition by pollutant order by month rows between 2 preceding and 2 following) as s1 from monthly),
k as (select *, avg(s1) over (partition by pollutant order by month rows between 2 preceding and 2 following) as s from a)"""


@query("monthly", KZ + " select pollutant, month, value, round(s, 6) as smooth from k")
def kz_filter(spark, sf):
    return r6(T.moving_average(V.monthly(spark, sf), ["pollutant"], "month", 5, 2))


@query("monthly", KZ + """, g as (select pollutant, coalesce(nullif(var_samp(value), 0), 1) as v, var_samp(s) as b, var_samp(value - s) as r, arg_max(s, month) - arg_min(s, month) as change from k group by 1)
select pollutant, round(least(1, b / v), 6)::double as background_share, round(least(1, r / v), 6)::double as residual_share, round(change, 6) as baseline_change, round(sqrt(r), 6) as residual_std from g""")
def kz_decomposition(spark, sf):
    return r6(T.kz_decomposition(V.monthly(spark, sf), ["pollutant"], "month"))


@query("air_long", """with s as (select station, avg(value) as m from air_long group by 1), x as (select station, m, unnest([station * 1.0::double, (station * 7 % 11)::double, (station * station % 13)::double]) as v, unnest([1, 2, 3]) as metric from s)
select metric::bigint as metric, round(coalesce(covar_pop(v, m) / nullif(sqrt(var_pop(v) * var_pop(m)), 0), 0), 6) as r, count(*) as n from x group by metric""")
def context_correlations(spark, sf):
    s = V.air_long(spark, sf).groupBy("station").agg(F.avg("value").alias("m"))
    k = F.col("station")
    x = s.select("m", F.posexplode(F.array(k.cast("double"), (k * 7 % 11).cast("double"), (k * k % 13).cast("double"))).alias("i", "v"))
    return r6(T.pearson(x.withColumn("metric", F.col("i") + 1), ["metric"], "v", "m"))


# wind ----------------------------------------------------------------------------------------------------------------
@query("daily meteo", """with b as (select d.pollutant, ((floor(m.wind_dir / 45 + 0.5)::int) % 8) + 1 as k, avg(d.value) as value, avg(m.wind_speed) as wind, count(*) as n from daily d join meteo m on d.station = m.station and d.day = m.day group by all),
k as (select p.pollutant, r.k from (select distinct pollutant from daily) p, (select unnest(range(1, 9)) as k) r)
select k.pollutant, (['K', 'KD', 'D', 'GD', 'G', 'GB', 'B', 'KB'])[k.k] as bin, round(coalesce(value, 0), 6) as value, round(coalesce(wind, 0), 6) as wind, coalesce(n, 0) as n from k left join b on k.pollutant = b.pollutant and k.k = b.k""")
def pollution_rose(spark, sf):
    d = V.daily(spark, sf)
    b = d.join(V.meteo(spark, sf), ["station", "day"]).groupBy("pollutant", S.compass("wind_dir").alias("bin")).agg(F.avg("value").alias("value"), F.avg("wind_speed").alias("wind"), F.count(F.lit(1)).alias("n"))
    bins = d.select("pollutant").distinct().select("pollutant", F.explode(F.array(*map(F.lit, S.COMPASS))).alias("bin"))
    return r6(bins.join(b, ["pollutant", "bin"], "left").fillna(0))


CIRCLE = "degrees(atan2(sum(sin(radians(wind_dir))), sum(cos(radians(wind_dir)))))"


@query("meteo", f"""select day, round(avg(temperature), 6) as temperature, round(avg(wind_speed), 6) as wind_speed, round((({CIRCLE}) % 360 + 360) % 360, 6) as wind_dir, round(avg(pressure), 6) as pressure, round(sum(precipitation), 6) as precipitation from meteo group by day""")
def daily_meteo_rollup(spark, sf):
    m = V.meteo(spark, sf)
    return r6(m.groupBy("day").agg(F.avg("temperature").alias("temperature"), F.avg("wind_speed").alias("wind_speed"), T.circular_mean("wind_dir").alias("wind_dir"), F.avg("pressure").alias("pressure"), F.sum("precipitation").alias("precipitation")))


@query("meteo", "select station, max(day) as day, arg_max(wind_dir, day) as wind_dir, arg_max(wind_speed, day) as wind_speed from meteo where day <= date '2024-01-20' group by station having arg_max(wind_speed, day) > 0.2")
def latest_meteo(spark, sf):
    m = V.meteo(spark, sf).where(F.col("day") <= F.lit("2024-01-20").cast("date"))
    return m.groupBy("station").agg(F.max("day").alias("day"), F.max_by("wind_dir", "day").alias("wind_dir"), F.max_by("wind_speed", "day").alias("wind_speed")).where("wind_speed > 0.2")


# events --------------------------------------------------------------------------------------------------------------
@query("evt", "select event_id, kind, start_day, end_day from evt where end_day >= date '2024-01-10' and start_day <= date '2024-01-16'")
def event_overlap(spark, sf):
    return E.overlapping(V.evt(spark, sf), "2024-01-10", "2024-01-16").select("event_id", "kind", "start_day", "end_day")


@query("evt", f"""with c as (select * from evt where event_id <= 3), f as (select * from evt where event_id > 3)
select event_id, kind, start_day from c union all select event_id, kind, start_day from f where not (kind = 'fire' and exists (select 1 from c where c.kind = 'fire' and abs(f.start_day - c.start_day) <= 5 and {V.haversine('f.lat', 'f.lng', 'c.lat', 'c.lng')} <= 35000))""")
def event_catalog_merge(spark, sf):
    e = V.evt(spark, sf)
    return E.merged_catalogue(e.where("event_id <= 3"), e.where("event_id > 3")).select("event_id", "kind", "start_day")


BEARING = "((degrees(atan2(sin(radians(s.lng) - radians(e.lng)) * cos(radians(s.lat)), cos(radians(e.lat)) * sin(radians(s.lat)) - sin(radians(e.lat)) * cos(radians(s.lat)) * cos(radians(s.lng) - radians(e.lng)))) % 360) + 360) % 360"


@query("evt geo daily meteo", f"""with s as (select id, lat, lng from geo),
d as (select station, day, avg(value) as value from daily group by all),
w as (select event_id, station, (({CIRCLE}) % 360 + 360) % 360 as wind from meteo join evt on day between start_day and end_day group by all),
m as (select event_id, station, avg(value) filter (day between start_day - 7 and start_day - 1) as b, avg(value) filter (day between start_day and end_day) as u, avg(value) filter (day between end_day + 4 and end_day + 14) as a,
  avg(value) filter (month(day) = month(start_day) and year(day) <> year(start_day)) as l from d, evt group by all),
p as (select e.event_id, s.id as station, {V.haversine('e.lat', 'e.lng', 's.lat', 's.lng')} / 1000 as km, {BEARING} as bearing, e.radius_km from evt e, s),
j as (select p.*, (coalesce(wind, 0) + 180) % 360 as towards, b, u, a, l from p left join w on p.event_id = w.event_id and p.station = w.station left join m on p.event_id = m.event_id and p.station = m.station),
q as (select *, cos(radians(case when abs(towards - bearing) > 180 then 360 - abs(towards - bearing) else abs(towards - bearing) end)) as al from j)
select event_id, station, round(km, 6) as distance_km, round(al, 6) as alignment, case when km <= 5 * radius_km and al > 0.15 then 'exposed' else 'control' end as status,
  round(b, 6) as before_mean, round(u, 6) as during_mean, round(a, 6) as after_mean, round(l, 6) as baseline_mean, round(u - l, 6) as delta from q""")
def event_impact(spark, sf):
    d = V.daily(spark, sf).groupBy("station", "day").agg(F.avg("value").alias("value"))
    return r6(E.impact(V.evt(spark, sf), V.geo(spark, sf).select("id", "lat", "lng"), d, V.meteo(spark, sf)))


# geometry and surfaces -----------------------------------------------------------------------------------------------
@query("geo", f"select id, round({V.haversine('lat', 'lng', '40.19', '29.06')}, 4) as metres from geo")
def haversine_distance(spark, sf):
    return V.geo(spark, sf).select("id", F.round(G.haversine_m("lat", "lng", F.lit(40.19), F.lit(29.06)), 4).alias("metres"))


@query("geo", f"select s.id, round({BEARING}, 6) as bearing from geo s, (select 40.19::double as lat, 29.06::double as lng) e")
def bearing_degrees(spark, sf):
    return r6(V.geo(spark, sf).select("id", G.bearing(F.lit(40.19), F.lit(29.06), "lat", "lng").alias("bearing")))


RING = [(28.3, 39.7), (29.6, 39.8), (29.4, 40.6), (28.9, 40.2), (28.4, 40.5)]
_SIDES = "(values " + ", ".join(str((*p, *q)) for p, q in zip(RING, [*RING[1:], RING[0]], strict=True)) + ") r(x1, y1, x2, y2)"


def _ring():
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in RING])


@query("geo", f"select id, count(*) filter ((y1 > lat) <> (y2 > lat) and lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1 as inside from geo, {_SIDES} group by id")
def point_in_polygon(spark, sf):
    return V.geo(spark, sf).select("id", G.in_ring("lng", "lat", _ring()).alias("inside"))


@query("geo", """with r as (select id, [lng, lng + a, lng + a, lng] as x, [lat, lat, lat + b, lat + 2 * b] as y from (select id, lng, lat, (id % 5 + 1) / 100.0::double as a, (id % 3 + 1) / 100.0::double as b from geo)),
e as (select id, x[i] - x[1] as x1, y[i] - y[1] as y1, x[i % 4 + 1] - x[1] as x2, y[i % 4 + 1] - y[1] as y2, x[1] as x0, y[1] as y0 from r, range(1, 5) t(i))
select id, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 6) as area, round(any_value(x0) + sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 4) as cx, round(any_value(y0) + sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 4) as cy from e group by id""")
def polygon_area_centroid(spark, sf):
    a, b = (F.col("id") % 5 + 1) / 100.0, (F.col("id") % 3 + 1) / 100.0
    corner = lambda x, y: F.struct((F.col("lng") + x).alias("x"), (F.col("lat") + y).alias("y"))
    zero = F.lit(0.0)
    ring = F.array(corner(zero, zero), corner(a, zero), corner(a, b), corner(zero, 2 * b))
    cx, cy = G.ring_centroid(F.col("ring"))
    return V.geo(spark, sf).withColumn("ring", ring).select("id", S.rounded(G.ring_area(F.col("ring"))).alias("area"), F.round(cx, 4).alias("cx"), F.round(cy, 4).alias("cy"))


@query("geo", """with t as (select id, lng, lat, greatest(0, least(1, ((lng - 28.5) * 1.0 + (lat - 39.9) * 0.5) / 1.25)) as t from geo) select id, round(sqrt(power(lng - 28.5 - t * 1.0, 2) + power(lat - 39.9 - t * 0.5, 2)), 6) as distance from t""")
def point_segment_distance(spark, sf):
    return r6(V.geo(spark, sf).select("id", G.segment_distance("lng", "lat", F.lit(28.5), F.lit(39.9), F.lit(29.5), F.lit(40.4)).alias("distance")))


@query("geo", f"""with d as (select g.id, r.id as other, round({V.haversine('g.lat', 'g.lng', 'r.lat', 'r.lng')}, 3) as metres from geo g join geo r on r.scope = 0 and g.id <> r.id)
select id, other, metres, rank from (select *, row_number() over (partition by id order by metres, other) as rank from d) where rank <= 3""")
def knn3_stations(spark, sf):
    g = V.geo(spark, sf)
    return r6(N.nearest(g, g.where("scope = 0"), 3))


@query("geo", f"select a.scope, a.id as a, b.id as b, round({V.haversine('a.lat', 'a.lng', 'b.lat', 'b.lng')}, 4) as metres from geo a join geo b on a.scope = b.scope and a.id <> b.id")
def distance_matrix(spark, sf):
    return X.matrix(V.geo(spark, sf), ["scope"])


GRID = (39.60, 28.09, 40.75, 29.89)
_DLAT = 5 / 110.574
_DLNG = 5 / (111.32 * __import__("math").cos(__import__("math").radians((GRID[0] + GRID[2]) / 2)))
_ROWS, _COLS = (-int(-(GRID[2] - GRID[0]) // _DLAT), -int(-(GRID[3] - GRID[1]) // _DLNG))
GRID_SQL = f"g as (select format('r{{:03d}}c{{:03d}}', i // {_COLS}, i % {_COLS}) as cell_id, 39.60::double + (i // {_COLS} + 0.5::double) * {_DLAT!r}::double as lat, 28.09::double + (i % {_COLS} + 0.5::double) * {_DLNG!r}::double as lng from (select unnest(range(0, {_ROWS * _COLS})) as i))"
GRID_CTE = f"with {GRID_SQL}"


EXTENT_SQL = "x as (select round(min(lat) - 0.05, 6) as south, round(min(lng) - 0.05, 6) as west, round(max(lat) + 0.05, 6) as north, round(max(lng) + 0.05, 6) as east from geo)"


@query("geo", f"""with {EXTENT_SQL}, d as (select *, 5 / 110.574::double as dlat, 5 / (111.32::double * greatest(cos(radians((south + north) / 2)), 0.25)) as dlng from x),
r as (select *, unnest(range(0, floor((north - south - dlat / 2) / dlat)::bigint + 1)) as row from d), q as (select *, unnest(range(0, floor((east - west - dlng / 2) / dlng)::bigint + 1)) as col from r)
select format('r{{:03d}}c{{:03d}}', row, col) as cell_id, round(south + dlat / 2 + row * dlat, 6) as lat, round(west + dlng / 2 + col * dlng, 6) as lng from q""")
def grid_cells(spark, sf):
    return r6(B.cells(B.extent(None, V.geo(spark, sf))).select("cell_id", "lat", "lng"))


IDW = f"with {GRID_SQL}, w as (select scope, cell_id, value, 1 / power(greatest({V.haversine('g.lat', 'g.lng', 's.lat', 's.lng')}, 1.0), 2) as w from g, geo s), f as (select scope, cell_id, sum(value * w) / sum(w) as value from w group by all)"


def _surface(spark, sf):
    return X.idw(X.grid(spark, *GRID), V.geo(spark, sf), ["scope"])


@query("geo", IDW + " select scope, cell_id, round(value, 4) as value from f")
def idw_surface(spark, sf):
    return _surface(spark, sf).withColumn("value", F.round("value", 4))


@query("geo", IDW + " select scope, cell_id, round(value, 4) as value, rank from (select *, row_number() over (partition by scope order by round(value, 4) desc, cell_id) as rank from f) where rank <= 5")
def surface_top_cells(spark, sf):
    return r6(E.top(idw_surface(spark, sf), ["scope"], "value", 5, "cell_id"))


@query("geo", IDW + " select scope, round(avg(value), 4) as mean, round(min(value), 4) as low, round(max(value), 4) as high, round(median(value), 4) as median, round(stddev_samp(value), 4) as sd from f group by scope")
def surface_stats(spark, sf):
    s = _surface(spark, sf).groupBy("scope")
    return s.agg(*[F.round(f("value"), 4).alias(n) for f, n in ((F.avg, "mean"), (F.min, "low"), (F.max, "high"), (F.median, "median"), (F.stddev_samp, "sd"))])


DIST = f"d as (select a.scope, a.id as a, b.id as b, a.value as va, b.value as vb, {V.haversine('a.lat', 'a.lng', 'b.lat', 'b.lng')} as metres from geo a join geo b on a.scope = b.scope and a.id <> b.id)"


@query("geo", f"with {DIST}, g as (select scope, a, va, sum(vb / power(greatest(metres, 1.0), 2)) / sum(1 / power(greatest(metres, 1.0), 2)) as guess from d group by all) select scope, round(sqrt(avg(power(va - guess, 2))), 4) as rmse, count(*) as n from g group by scope")
def idw_loocv_rmse(spark, sf):
    return X.idw_loocv(V.geo(spark, sf), ["scope"]).withColumn("rmse", F.round("rmse", 4))


RADIUS = DIST + ", k as (select scope, a, metres, row_number() over (partition by scope, a order by metres) as r from d where metres > 0), radius as (select scope, max(metres) as radius from k where r <= 3 group by scope)"


@query("geo", f"with {RADIUS} select scope, round(radius, 4) as radius from radius")
def adaptive_radius(spark, sf):
    return X.adaptive_radius(V.geo(spark, sf), ["scope"]).withColumn("radius", F.round("radius", 4))


@query("geo", f"""with {RADIUS}, s as (select scope, avg(value) as m, var_pop(value) as v, count(*) as n from geo group by scope)
select d.scope, any_value(n) as n, count(*) as links, round(any_value(radius), 6) as radius, round(coalesce(avg((va - m) * (vb - m)) / nullif(any_value(v), 0), 0), 6) as moran_i
from d join radius on d.scope = radius.scope and metres <= radius join s on d.scope = s.scope group by d.scope""")
def global_moran(spark, sf):
    return r6(X.moran(V.geo(spark, sf), ["scope"]))


@query("geo", f"""with {RADIUS}, s as (select scope, avg(value) as m, stddev_samp(value) as sd, count(*)::double as n from geo group by scope),
e as (select d.scope, a, vb from d join radius on d.scope = radius.scope and metres <= radius union all select scope, id, value from geo),
x as (select e.scope, a as id, sum(vb) as t, count(*)::double as w from e group by all),
y as (select x.scope, id, round(coalesce((t - m * w) / nullif(sd * sqrt((n * w - w * w) / (n - 1)), 0), 0), 6) as z from x join s on x.scope = s.scope)
select scope, id, z, round({P_OF}, 6)::double as p_value, case when z >= 2.58 then 'hotspot-99' when z >= 1.96 then 'hotspot-95' when z >= 1.65 then 'hotspot-90' when z <= -2.58 then 'coldspot-99' when z <= -1.96 then 'coldspot-95' when z <= -1.65 then 'coldspot-90' else 'not-significant' end as class from y""")
def getis_ord(spark, sf):
    return r6(X.getis_ord(V.geo(spark, sf), ["scope"]))


RISK_IN = "select scope, id, value, (id * 17 % 100) / 100.0::double as hotspot, (id * 29 % 100) / 100.0::double as proximity, (id * 43 % 100) / 100.0::double as green, (id * 7 % 30)::double as slope, (id * 13 % 900)::double as elevation from geo"


@query("geo", f"""with c as ({RISK_IN}), n as (select *, coalesce((value - min(value) over w) / nullif(max(value) over w - min(value) over w, 0), 0) as p, coalesce(1 - (slope - min(slope) over w) / nullif(max(slope) over w - min(slope) over w, 0), 0) as s,
  coalesce(1 - (elevation - min(elevation) over w) / nullif(max(elevation) over w - min(elevation) over w, 0), 0) as e from c window w as (partition by scope)),
r as (select scope, id, round(0.40 * p + 0.20 * hotspot + 0.20 * proximity + 0.10 * (1 - green) + 0.10 * (0.6 * s + 0.4 * e), 6)::double as score from n)
select scope, id, score, case when score >= 0.75 then 'Cok yuksek' when score >= 0.55 then 'Yuksek' when score >= 0.35 then 'Orta' else 'Dusuk' end as label from r""")
def risk_overlay(spark, sf):
    return X.risk(_risk_cells(spark, sf), ["scope"]).select("scope", "id", "score", "label")


def _risk_cells(spark, sf):
    i = F.col("id")
    return V.geo(spark, sf).select("scope", "id", "value", (i * 17 % 100 / 100.0).alias("hotspot"), (i * 29 % 100 / 100.0).alias("proximity"), (i * 43 % 100 / 100.0).alias("green"), (i * 7 % 30).cast("double").alias("slope"), (i * 13 % 900).cast("double").alias("elevation"))


@query()
def driver_regression(spark, sf):
    return X.drivers(_risk_cells(spark, sf), ["scope"], "value", ["hotspot", "proximity", "green", "slope", "elevation"])


@query()
def kriging_surface(spark, sf):
    cells = X.grid(spark, *GRID).toPandas()  # a grid of fixed extent
    return r6(X.kriging(V.geo(spark, sf), cells, ["scope"]))


@query()
def moran_permutation(spark, sf):
    return X.moran_permutation(V.geo(spark, sf), ["scope"], "scope")


@query()
def fire_clusters(spark, sf):
    a = V.air(spark, sf).where("pollutant = 'error'").join(V.geo(spark, sf).select(F.col("id").alias("station"), "lat", "lng"), "station")
    return X.clusters(a.select(F.col("event_id").alias("id"), "ts", "lat", "lng", (F.col("event_id") % 101).cast("double").alias("confidence")))


# forecasts -----------------------------------------------------------------------------------------------------------
FILL = """f as (select c.pollutant, c.day, n.value as v from (select pollutant, unnest(generate_series(min(day), max(day), interval 1 day))::date as day from network_daily group by pollutant) c left join network_daily n on n.pollutant = c.pollutant and n.day = c.day),
b as (select *, last_value(case when v is not null then {'d': day, 'v': v} end ignore nulls) over (partition by pollutant order by day rows unbounded preceding) as p, first_value(case when v is not null then {'d': day, 'v': v} end ignore nulls) over (partition by pollutant order by day rows between current row and unbounded following) as q from f),
filled as (select pollutant, day, coalesce(v, p.v + (q.v - p.v) * ((day - p.d)::double / nullif(q.d - p.d, 0)), p.v, q.v) as value, v is not null as observed from b)"""


def _filled(spark, sf):
    return P.filled(V.network_daily(spark, sf), ["pollutant"])


@query("network_daily", f"with {FILL} select pollutant, day, round(value, 6) as value, observed from filled")
def gap_fill(spark, sf):
    return r6(_filled(spark, sf))


def _forecast_sql(name: str, source: str, h: int) -> str:
    return f"""{name}_r as (select *, row_number() over (partition by pollutant order by day desc) as r from {source}),
{name}_a as (select pollutant, max(day) as e, arg_max(value, day) as last, regr_slope(value, -r::double) as slope, list(value order by r) filter (r <= 7) as week from {name}_r where r <= 28 group by 1),
{name} as (select pollutant, h, e + h::int as day, week[7 - (h - 1) % 7] as naive, last + slope * (1 - power(0.82, h)) / (1 - 0.82) as damped from {name}_a, (select unnest(range(1, {h + 1})) as h))"""


@query("network_daily", f"with {FILL}, {_forecast_sql('g', 'filled', 7)} select pollutant, h, day, round(naive, 4) as naive, round(damped, 4)::double as damped, round((naive + damped) / 2, 4)::double as value from g")
def ensemble_forecast(spark, sf):
    f = P.forecasts(_filled(spark, sf), ["pollutant"], 7)
    return f.select("pollutant", F.col("h").cast("long").alias("h"), "day", *[F.round(c, 4).alias(c) for c in ("naive", "damped", "value")])


@query("network_daily", f"""with {FILL}, m as (select *, row_number() over (partition by pollutant order by day desc) as back from filled), t as (select pollutant, day, value from m where back > 7), {_forecast_sql('g', 't', 7)},
e as (select m.pollutant, m.value - (naive + damped) / 2 as e from m join g on m.pollutant = g.pollutant and m.day = g.day where back <= 7)
select pollutant, round(avg(abs(e)), 4)::double as mae, round(sqrt(avg(e * e)), 4)::double as rmse, count(*) as n from e group by 1""")
def forecast_backtest(spark, sf):
    b = P.backtest(_filled(spark, sf), ["pollutant"], 7)
    return b.select("pollutant", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), "n")


# merging -------------------------------------------------------------------------------------------------------------
_SLICES = "s as (select station, date_trunc('month', day)::date as start_day, last_day(day) as end_day, avg(value) as mean, case when month(day) % 5 <> 0 then max(value) end as peak from air_long group by station, date_trunc('month', day), last_day(day), month(day)), w as (select *, greatest(least(end_day, date '1997-05-20') - greatest(start_day, date '1997-01-10') + 1, 0) as w from s)"


def _merged(spark, sf):
    m = F.trunc("day", "month")
    slices = V.air_long(spark, sf).groupBy("station", m.alias("start_day")).agg(F.avg("value").alias("mean"), F.max("value").alias("peak")).withColumn("end_day", F.last_day("start_day")).withColumn("peak", F.when(F.month("start_day") % 5 != 0, F.col("peak")))
    return E.day_weighted(slices, ["station"], ["mean", "peak"], "1997-01-10", "1997-05-20")


@query("air_long", f"with {_SLICES} select station, round(sum(mean * w) / sum(w), 6) as mean, round(sum(peak * w) / sum(w) filter (peak is not null), 6) as peak, sum(w)::bigint as days, count(*) as slices from w where w > 0 group by station")
def merge_surface(spark, sf):
    return r6(_merged(spark, sf)).withColumn("station", F.col("station").cast("int"))


@query("air_long", f"with {_SLICES}, m as (select station, round(sum(mean * w) / sum(w), 6) as mean from w where w > 0 group by station) select station, mean, row_number() over (order by mean desc, station) as rank from m qualify rank <= 6")
def top_bottom_cells(spark, sf):
    first = merge_surface(spark, sf).where("mean is not null").orderBy(F.col("mean").desc(), "station").limit(6)
    return first.withColumn("all", F.lit(1)).transform(E.top, ["all"], "mean", 6, "station").select("station", "mean", F.col("rank").cast("long").alias("rank"))


# sets and scalars ----------------------------------------------------------------------------------------------------
@query("air", "select station, ts, value, 'official' as source from air where station % 4 = 0 union all select station, ts, value, 'sensor' from air where station % 4 = 1")
def union_sources(spark, sf):
    a = V.air(spark, sf).select("station", "ts", "value")
    return a.where("station % 4 = 0").withColumn("source", F.lit("official")).unionByName(a.where("station % 4 = 1").withColumn("source", F.lit("sensor")))


@query("air geo", "select station, pollutant, count(*) as n from air where station in (select id from geo where scope = 2) group by all")
def orphan_removal(spark, sf):
    keep = V.geo(spark, sf).where("scope = 2").select(F.col("id").alias("station"))
    return V.air(spark, sf).join(keep, "station", "left_semi").groupBy("station", "pollutant").agg(F.count(F.lit(1)).alias("n"))


@query("", """select p_partkey, trim(regexp_replace(regexp_replace(replace(replace(lower(p_name || ' / ' || p_type), '/', '-'), ' ', '-'), '[^a-z0-9-]+', '-', 'g'), '-{2,}', '-', 'g'), '-') as slug from part""")
def slugify(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", S.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


@query("", """with u as (select l_orderkey, l_linenumber, l_extendedprice as v, (['µg/m3', 'mg/m3', 'ug/m3'])[l_linenumber % 3 + 1] as unit, case when l_suppkey % 2 = 0 then 'CO' else 'PM10' end as pollutant from lineitem)
select l_orderkey, l_linenumber, round(case when pollutant = 'CO' and unit <> 'mg/m3' then v / 1000 when pollutant <> 'CO' and unit = 'mg/m3' then v * 1000 else v end, 6) as value, case when pollutant = 'CO' then 'mg/m3' else 'ug/m3' end as unit from u""")
def unit_conversion(spark, sf):
    units = F.element_at(F.array(*map(F.lit, ("µg/m3", "mg/m3", "ug/m3"))), F.col("l_linenumber") % 3 + 1)
    pollutant = F.when(F.col("l_suppkey") % 2 == 0, "CO").otherwise("PM10")
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.converted("l_extendedprice", units, pollutant).alias("value"), S.canonical_unit(pollutant).alias("unit"))


@query("", "select event_id, date_trunc('second', ts) as a, date_trunc('minute', ts) as b, date_trunc('day', ts) as c from events")
def parse_timestamps(spark, sf):
    t = V.table(spark, sf, "events")
    out = [S.parsed_timestamp(F.date_format("ts", f)).cast("timestamp_ntz").alias(n) for n, f in (("a", "yyyy-MM-dd HH:mm:ss"), ("b", "dd.MM.yyyy HH:mm"), ("c", "yyyy-MM-dd"))]
    return t.select("event_id", *out)


@query("geo", "select id, lat, lng from geo")
def wkt_point(spark, sf):
    text = F.concat(F.lit("POINT("), F.col("lng").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")"))
    lat, lng = S.wkt_point("wkt")
    return V.geo(spark, sf).select("id", text.alias("wkt")).select("id", lat.alias("lat"), lng.alias("lng"))


@query("", "select o_orderkey, timestamp '1899-12-30' + to_days(45000) + to_seconds(o_orderkey % 86400) as ts from orders")
def excel_serial(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", S.excel_time(45000 + (F.col("o_orderkey") % 86400) / 86400).cast("timestamp_ntz").alias("ts"))


@query("", """select event_id, case when value >= 90 then 'very-high' when value >= 60 then 'high' when value >= 35 then 'moderate' else 'low' end as band, (['K', 'KD', 'D', 'GD', 'G', 'GB', 'B', 'KB'])[(floor((event_id % 360) / 45.0 + 0.5)::int) % 8 + 1] as compass,
  case when month(ts) = 12 then year(ts) + 1 else year(ts) end as season_year, (month(ts) % 12) // 3 as season from events""")
def scalars_bands(spark, sf):
    t = V.table(spark, sf, "events")
    out = t.select("event_id", S.banded("value", (90, 60, 35), ("very-high", "high", "moderate", "low")).alias("band"), S.compass((F.col("event_id") % 360).cast("double")).alias("compass"), S.season_year("ts").alias("season_year"), S.season_index("ts").alias("season"))
    return r6(out)


@query("", """with e as (select min(o_orderdate)::date as lo, max(o_orderdate)::date as hi from orders), m as (select lo, hi, unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), interval 1 month))::date as m from e)
select greatest(m, lo) as start_day, least(last_day(m), hi) as end_day from m""")
def month_windows(spark, sf):
    days = V.table(spark, sf, "orders").agg(F.to_date(F.min("o_orderdate")).alias("start_day"), F.to_date(F.max("o_orderdate")).alias("end_day"))
    return landed.months(days).select("start_day", "end_day")


@query("daily", "select pollutant, count(*) as n, round(avg(value), 6) as mean, round(coalesce(stddev_samp(value), 0), 6) as sd, round(coalesce(var_samp(value), 0), 6) as variance, round(median(value), 6) as median from daily group by 1")
def agg_primitives(spark, sf):
    v = V.daily(spark, sf).groupBy("pollutant")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return r6(v.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), zero(F.stddev_samp("value")).alias("sd"), zero(F.var_samp("value")).alias("variance"), F.median("value").alias("median")))


@query("air", "select station, pollutant, ts, round(value, 3) as value, event_id from air order by ts, event_id limit 12 offset 24")
def paged_view(spark, sf):
    a = V.air(spark, sf).select("station", "pollutant", "ts", F.round("value", 3).alias("value"), "event_id")
    return a.orderBy("ts", "event_id").offset(24).limit(12)


@query("daily meteo", """with m as (select pollutant, day, avg(value) as v from daily group by all), e as (select pollutant, count(*) filter (v > 50) as exceedance_days from m group by 1)
select d.pollutant, round(avg(d.value), 6) as mean, round(corr(d.value, t.wind_speed), 6) as wind_correlation, any_value(exceedance_days) as exceedance_days, count(*) as n from daily d join meteo t on d.station = t.station and d.day = t.day join e on d.pollutant = e.pollutant group by d.pollutant""")
def temporal_summary(spark, sf):
    """Mean, wind correlation and days over the threshold of each pollutant: the flagship."""
    d = V.daily(spark, sf)
    over = d.groupBy("pollutant", "day").agg(F.avg("value").alias("v")).groupBy("pollutant").agg(F.count_if(F.col("v") > 50).alias("exceedance_days"))
    j = d.join(V.meteo(spark, sf), ["station", "day"])
    out = T.pearson(j, ["pollutant"], "value", "wind_speed").join(j.groupBy("pollutant").agg(F.avg("value").alias("mean")), "pollutant").join(over, "pollutant")
    return r6(out.select("pollutant", "mean", F.col("r").alias("wind_correlation"), "exceedance_days", "n"))
