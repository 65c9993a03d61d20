"""Queries of slices: gates, statistics, merging, selection and rows for export, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from windrow.functions import geo as G
from windrow.functions import scalars as S
from windrow.operators import packages as K
from windrow.operators import results as R
from windrow.operators import slices as L
from windrow.operators import spatial as X
from windrow.operators import surfaces as U
from windrow.operators.tables import shared_folder, written
from windrow.plans import assembled as A
from windrow.plans import catalogue as C
from windrow.plans import views as V
from windrow.plans.catalogue import query, r6
from windrow.sources import dataset as D

COVERAGE = ("1995-01-01", "2024-01-31")
SLICES = f"""s as (select 'month-' || strftime(m, '%Y-%m') as slice_id, 'month' as kind, strftime(m, '%Y-%m') as label, m as start_day, last_day(m) as end_day from (select unnest(generate_series(date '1995-01-01', date '2024-01-01', interval 1 month))::date as m)
  union all select 'event-' || event_id, 'event', event_id::varchar, start_day, end_day from evt where end_day >= date '{COVERAGE[0]}' and start_day <= date '{COVERAGE[1]}'),
e as (select *, greatest(start_day, date '{COVERAGE[0]}') as from_day, least(end_day, date '{COVERAGE[1]}') as to_day from s)"""
LIMIT = "case pollutant when 'PM10' then 50.0::double else 100.0::double end"
OBS = f"""{SLICES}, o as (select slice_id, pollutant, scope, station as id, any_value(lat) as lat, any_value(lng) as lng, avg(d.value) as value, avg((d.value > {LIMIT})::int::double) as over, count(distinct day) as days, least(1.0, count(distinct day)::double / any_value(to_day - from_day + 1))::double as completeness
  from ship d join e on day between from_day and to_day join ship_at on id = station group by slice_id, pollutant, scope, station),
q as (select slice_id, pollutant, scope, count(distinct id) as station_count, sum(days)::bigint as observation_count, avg(completeness) as mean_completeness,
  case when count(distinct id) < 6 then 'insufficient-observations' when avg(completeness) < 0.7 then 'insufficient-completeness' else 'ok' end as status from o group by all)"""
KEYS = U.KEYS
ON = "a.slice_id = b.slice_id and a.pollutant = b.pollutant and a.scope = b.scope"


def _slices(spark, sf):
    return U.coverage_slices(V.evt(spark, sf), *COVERAGE)


def _observations(spark, sf):
    return written(U.observations(V.ship(spark, sf), _slices(spark, sf), V.ship_at(spark, sf), S.THRESHOLDS), "observations")


@query("evt ship ship_at", f"with {OBS} select slice_id, pollutant, scope, station_count, observation_count, round(mean_completeness, 6) as mean_completeness, status from q")
def stats_gates(spark, sf):
    return r6(L.gates(_observations(spark, sf), KEYS))


PAIRS = f"""k as materialized (select o.* from o join q using (slice_id, pollutant, scope) where status = 'ok'),
d as materialized (select a.slice_id, a.pollutant, a.scope, a.id as a, a.value as va, b.value as vb, {V.haversine('a.lat', 'a.lng', 'b.lat', 'b.lng')} as metres from k a join k b on {ON} and a.id <> b.id),
n as (select *, row_number() over (partition by slice_id, pollutant, scope, a order by metres) as r from d where metres > 0), w as (select slice_id, pollutant, scope, max(metres) as radius from n where r <= 3 group by all)"""


@query("evt ship ship_at", f"""with {OBS}, {PAIRS}, m as (select slice_id, pollutant, scope, avg(value) as mean, var_pop(value) as v from k group by all),
i as (select slice_id, pollutant, scope, any_value(radius) as radius, avg((va - mean) * (vb - mean)) / nullif(any_value(v), 0) as moran_i from d join w using (slice_id, pollutant, scope) join m using (slice_id, pollutant, scope) where metres <= radius group by all)
select slice_id, pollutant, scope, station_count, case when status = 'ok' and moran_i is null then 'insufficient-observations' else status end as status, round(radius, 2)::double as radius, round(moran_i, 4)::double as moran_i from q left join i using (slice_id, pollutant, scope)""")
def stats_slices(spark, sf):
    out = L.stats(_observations(spark, sf), [*KEYS, "label"], "label")
    return out.select(*KEYS, "station_count", "status", "radius", "moran_i")


@query()
def stats_slices_permuted(spark, sf):
    return L.stats(_observations(spark, sf), [*KEYS, "label"], "label")


@query("evt ship ship_at", f"""with {OBS}, p as materialized (select cell_id, o.slice_id, o.pollutant, o.scope, o.value, over, 1 / power(greatest(sqrt(power(radians(g.lng - o.lng) * cos(radians(39.60::double)), 2) + power(radians(g.lat - o.lat), 2)) * 6371000, 1.0), 2) as w
  from o join (select slice_id, pollutant, scope from o group by all having count(distinct id) >= 4 and avg(completeness) >= 0.7) using (slice_id, pollutant, scope), ({C.GRID_CTE} select * from g) g)
select slice_id, pollutant, scope, 'idw' as method, cell_id, round(sum(value * w) / sum(w), 2) as value, round(sum(over * w) / sum(w), 4) as exceedance from p group by all""")
def surface_slices_idw(spark, sf):
    """The surfaces of inverse distances of every month, event and scope; `surface_slices` has all else."""
    return U.surface_slices(_observations(spark, sf), _slices(spark, sf), _cells(spark), ORIGIN)[1].where("method = 'idw'")


@query()
def surface_slices(spark, sf):
    return U.surface_slices(_observations(spark, sf), _slices(spark, sf), _cells(spark), ORIGIN)[0]


@query()
def surface_slices_kriging(spark, sf):
    return U.surface_slices(_observations(spark, sf), _slices(spark, sf), _cells(spark), ORIGIN)[1].where("method = 'kriging'")


ORIGIN = C.GRID[:2]


def _cells(spark):
    return X.grid(spark, *C.GRID).select((F.col("row") * C._COLS + F.col("col")).cast("int").alias("i"), "cell_id", "lat", "lng")


def _inputs(spark, sf) -> K.Inputs:
    """Packages' inputs: the measurements of `ship`, with the map layers of `cell_context`."""
    industries = V.geo(spark, sf).where("scope = 1").select("id", "lat", "lng")
    meteo = V.ship(spark, sf).select("station", "day").distinct().withColumn("wind_dir", ((F.col("station") * 37 + F.dayofyear("day") * 13) % 360).cast("double"))
    return K.Inputs(V.ship(spark, sf), V.ship_at(spark, sf), V.evt(spark, sf), meteo, _cells(spark), A._contexts(spark, sf), industries, *COVERAGE, ORIGIN)


def _published(spark, sf):
    """The packages built, published and read back: (manifest, tables of PM10)."""
    path = f"{shared_folder(spark)}/windrow-packages-{uuid.uuid4().hex}"
    D.publish_packages(K.build(_inputs(spark, sf)), path, "v1", *COVERAGE)
    return D.published_packages(spark, path, "PM10")


@query("evt ship ship_at", f"""with {OBS}, g as (select slice_id, pollutant, scope, count(distinct id) as n, avg(completeness) as c from o group by all)
select pollutant, scope, count(*) filter (kind = 'month') as months, coalesce(sum((kind = 'month' and coalesce(n >= 4 and c >= 0.7, false))::int), 0)::bigint as usable_months, count(*) filter (kind = 'event') as events
from s cross join (select distinct pollutant, scope from o) left join g using (slice_id, pollutant, scope) group by pollutant, scope""")
def package_descriptors(spark, sf):
    return K.descriptors(U.gated(_observations(spark, sf), _slices(spark, sf)))


@query("evt ship ship_at", f"""with {OBS}, {PAIRS}, t as (select slice_id, pollutant, scope, avg(value) as mean, stddev_samp(value) as sd, count(*)::double as n from k group by all),
y as (select slice_id, pollutant, scope, a, sum(vb) as s, count(*)::double as w from (select slice_id, pollutant, scope, a, vb from d join w using (slice_id, pollutant, scope) where metres <= radius union all select slice_id, pollutant, scope, id, value from k) group by all),
z as (select *, coalesce((s - mean * w) / nullif(sd * sqrt((n * w - w * w) / (n - 1)), 0), 0) as z from y join t using (slice_id, pollutant, scope)),
v as (select z.*, {V.overlap_sql('start_day', 'end_day', '1998-02-10', '1998-05-20')} as days from z join s using (slice_id) where pollutant = 'PM10' and scope = 'all'),
r as (select a as station, round(sum(round(z, 4) * days) / sum(days), 6) as z from v where days > 0 group by a)
select station::varchar as station, z from r""")
def package_range_stations(spark, sf):
    """Stations of a range of days, from packages that were built, published and read back."""
    _, tables = _published(spark, sf)
    out = L.resolved(tables, L.Request("1998-02-10", "1998-05-20", scope="all"))["stations"]
    return out.select(F.col("station").cast("string").alias("station"), S.rounded("z").alias("z"))


@query("daily geo", f"""with {C.GRID_SQL}, o as (select pollutant, station, avg(d.value) as value, avg((d.value > 50)::int::double) as over, any_value(lat) as lat, any_value(lng) as lng from daily d join geo on geo.id = station group by pollutant, station),
k as (select pollutant from o group by 1 having count(*) >= 4), w as (select pollutant, cell_id, value, over, 1 / power(greatest({V.haversine('g.lat', 'g.lng', 'o.lat', 'o.lng')}, 1.0), 2) as w from g, o where pollutant in (select pollutant from k))
select pollutant, cell_id, round(sum(value * w) / sum(w), 6) as value, round(sum(over * w) / sum(w), 6) as exceedance from w group by all""")
def idw_exceedance_surface(spark, sf):
    return r6(L.exceedance(X.grid(spark, *C.GRID), V.daily(spark, sf), V.geo(spark, sf), ["pollutant"], 50.0))


# merging -------------------------------------------------------------------------------------------------------------
SLICE = "select 'month-' || strftime(month, '%Y-%m') as slice_id, 'month' as kind, strftime(month, '%Y-%m') as label, month as start_day, last_day(month) as end_day, {scope} as scope, {value} as value, {n}::double as n from monthly where {where}"
OLD = SLICE.format(scope="'physical'", value="value", n="1", where="pollutant = '1-URGENT' and month < date '1998-01-01'")
NEW = SLICE.format(scope="case when pollutant = '2-HIGH' then 'all' else 'physical' end", value="value * 2", n="2", where="pollutant in ('1-URGENT', '2-HIGH') and month >= date '1997-01-01'")


@query("monthly", f"""with r as (select *, 0 as age from ({OLD}) union all select *, 1 as age from ({NEW}))
select slice_id, arg_min(kind, age) as kind, arg_min(label, age) as label, arg_min(start_day, age) as start_day, arg_min(end_day, age) as end_day,
  arg_max(value, age) filter (scope = 'physical') as physical_value, arg_max(n, age) filter (scope = 'physical') as physical_n, arg_max(value, age) filter (scope = 'all') as all_value, arg_max(n, age) filter (scope = 'all') as all_n from r group by slice_id""")
def slice_upsert(spark, sf):
    m = V.monthly(spark, sf)
    text = F.date_format("month", "yyyy-MM")

    def slices(rows, scope, value, n):
        return rows.select(F.concat(F.lit("month-"), text).alias("slice_id"), F.lit("month").alias("kind"), text.alias("label"), F.col("month").alias("start_day"), F.last_day("month").alias("end_day"), scope.alias("scope"), value.alias("value"), F.lit(float(n)).alias("n"))

    old = slices(m.where("pollutant = '1-URGENT' and month < date '1998-01-01'"), F.lit("physical"), F.col("value"), 1)
    new = slices(m.where("pollutant in ('1-URGENT', '2-HIGH') and month >= date '1997-01-01'"), F.when(F.col("pollutant") == "2-HIGH", "all").otherwise("physical"), F.col("value") * 2, 2)
    return L.upserted(old, new, ["value", "n"])


@query("evt ship ship_at", f"""with {OBS}, {PAIRS}, h as (select slice_id, pollutant, scope, count(*) as hotspots from k join w using (slice_id, pollutant, scope) group by all)
select slice_id, p.pollutant, p.scope, coalesce(status, 'insufficient-observations') as stats_status, coalesce(hotspots, 0)::bigint as hotspots from s cross join (select distinct pollutant, scope from o) p left join q using (slice_id, pollutant, scope) left join h using (slice_id, pollutant, scope)""")
def surfaces_with_stats(spark, sf):
    obs = _observations(spark, sf)
    counted = L.hotspots(obs, KEYS).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("hotspots"))
    found = L.gates(obs, KEYS).join(counted, KEYS, "left").fillna(0, ["hotspots"])
    surfaces = U.gated(obs, _slices(spark, sf)).select(*KEYS)
    return L.with_stats(surfaces, found, KEYS)


CTX = "k as (select cell_id, (row_number() over (order by cell_id) % 7) / 7.0::double as u, (row_number() over (order by cell_id) * 13 % 500)::double as m from g), c as (select cell_id, u as road_density, 1 - u as green_ratio, u / 2 as impervious_ratio, u / 4 as proximity_index, m as nearest_primary_road_m, m * 2 as nearest_industry_m, m::bigint % 5 as industry_count, m as mean_elevation_m, u * 10 as slope_mean from k where m > 60)"


def _contexts(cells):
    i = F.col("row") * C._COLS + F.col("col") + 1
    k = cells.select("cell_id", (i % 7 / 7.0).alias("u"), (i * 13 % 500).cast("double").alias("m")).where("m > 60")
    return k.selectExpr("cell_id", "u as road_density", "1 - u as green_ratio", "u / 2 as impervious_ratio", "u / 4 as proximity_index", "m as nearest_primary_road_m", "m * 2 as nearest_industry_m", "cast(m as bigint) % 5 as industry_count", "m as mean_elevation_m", "u * 10 as slope_mean")


RISK = f"""f as ({C.ORACLES["idw_surface"]}), ctx as ({C.ORACLES["cell_context"]}), r as (select cell_id, round(least(1, value / 100000), 3)::double as score from f where scope = 0 and value >= 40000),
j as (select g.cell_id, lat, lng, score, case when score >= 0.75 then 'Cok yuksek' when score >= 0.55 then 'Yuksek' when score >= 0.35 then 'Orta' else 'Dusuk' end as label, score / 2 as part,
  road_density, green_ratio, impervious_ratio, nearest_road_m as nearest_primary_road_m, nearest_industry_m, industry_count from g join r on g.cell_id = r.cell_id left join (select * from ctx where nearest_industry_m < 12000) c on c.cell_id = g.cell_id)"""
ABOUT = "'PM10' as pollutant, '2024-01' as slice_label, 'month' as analysis_mode, 'physical' as training_scope"
FIXED = {"pollutant": "PM10", "slice_label": "2024-01", "analysis_mode": "month", "training_scope": "physical"}
PARTS = ("pollution_component", "hotspot_component", "proximity_component", "green_deficit", "topographic_compression")


def _risks(spark, sf):
    """Cells whose value has a risk, with the context of those that are near industry."""
    cells = X.grid(spark, *C.GRID)
    value = F.round("value", 4)
    risks = X.idw(cells, V.geo(spark, sf).where("scope = 0")).where(value >= 40000).select("cell_id", F.round(F.least(F.lit(1.0), value / 100000), 3).alias("score")).withColumn("label", S.risk_label("score"))
    risks = risks.select("*", *[(F.col("score") / 2).alias(part) for part in PARTS])
    contexts = A._contexts(spark, sf).where("nearest_industry_m < 12000").withColumnRenamed("nearest_road_m", "nearest_primary_road_m").drop("elevation", "slope")
    return L.risk_cells(cells.select("cell_id", "lat", "lng"), contexts, risks)


@query("", f"""with {C.GRID_SQL}, {RISK} select cell_id, round(lat, 6) as lat, round(lng, 6) as lng, score, label, coalesce(road_density, 0)::double as road_density, coalesce(industry_count, 0)::bigint as industry_count, nearest_industry_m from j""")
def cells_enriched(spark, sf):
    out = _risks(spark, sf).select("cell_id", "lat", "lng", "score", "label", "road_density", F.col("industry_count").cast("long").alias("industry_count"), "nearest_industry_m")
    return out.withColumns({"lat": S.rounded("lat"), "lng": S.rounded("lng")})


@query("", f"""with {C.GRID_SQL}, {RISK} select cell_id, {ABOUT}, round(lat, 6) as lat, round(lng, 6) as lng, round(score, 4) as risk_score, label as risk_label, {', '.join(f'round(part, 4) as {p}' for p in PARTS)},
  {', '.join(f'round(coalesce({c}, 0), 4)::double as {c}' for c in ('road_density', 'green_ratio', 'impervious_ratio'))}, nearest_primary_road_m, nearest_industry_m, coalesce(industry_count, 0)::bigint as industry_count_3km from j""")
def export_risk(spark, sf):
    return L.risk_rows(_risks(spark, sf), **FIXED).withColumns({"lat": S.rounded("lat"), "lng": S.rounded("lng")})


@query("geo", f"""with {C.IDW[5:]}, {CTX}, v as (select cell_id, value from f where scope = 0), e as (select g.cell_id, lat, lng, value, value / max(value) over () as load, c.* exclude (cell_id) from g join v on v.cell_id = g.cell_id left join c on c.cell_id = g.cell_id)
select cell_id, {ABOUT}, 'idw' as method, round(lat, 6) as lat, round(lng, 6) as lng, round(value, 4) as value, round(load, 4)::double as pollution_load, 0.25::double as exceedance_ratio, {', '.join(f'round(coalesce({c}, 0), 4)::double as {c}' for c in ('road_density', 'green_ratio', 'impervious_ratio', 'proximity_index'))},
  nearest_primary_road_m, nearest_industry_m, mean_elevation_m, round(slope_mean, 4) as slope_mean, coalesce(industry_count, 0)::bigint as industry_count_3km from e""")
def export_surface_whole(spark, sf):
    cells = X.grid(spark, *C.GRID)
    values = X.idw(cells, V.geo(spark, sf).where("scope = 0"))
    most = values.agg(F.max("value").alias("most"))
    values = values.join(most).select("cell_id", "value", (F.col("value") / F.col("most")).alias("pollution_load"), F.lit(0.25).alias("exceedance_ratio"))
    rows = L.risk_cells(cells.select("cell_id", "lat", "lng"), _contexts(cells), values)
    return L.surface_rows(rows, method="idw", **FIXED).withColumns({"lat": S.rounded("lat"), "lng": S.rounded("lng")})


@query("", f"""with z as ({C.ORACLES["getis_ord"]}), m as ({C.ORACLES["global_moran"]}), s as ({V.SQL["geo"]})
select s.id as station_id, 'station ' || s.id as station_name, {ABOUT}, lat, lng, round(value, 4) as value, round(z, 4) as z_score, round(p_value, 4) as p_value, round(1 - p_value, 4) as significance, class as classification,
  round(moran_i, 4) as global_moran_i, null::double as global_moran_z_score, null::double as global_moran_p_value from s join z on s.id = z.id join m on m.scope = s.scope""")
def export_stats(spark, sf):
    g = V.geo(spark, sf)
    spots = C.getis_ord(spark, sf).join(g.select("id", "lat", "lng", "value", F.concat(F.lit("station "), F.col("id").cast("string")).alias("station_name")), "id")
    null = F.lit(None).cast("double")
    found = C.global_moran(spark, sf).select("scope", "moran_i", null.alias("z"), null.alias("p_value"))
    return L.stats_rows(spots, found, ["scope"], **FIXED)


DRIVERS = "a as (select scope, driver, 'driver ' || driver as driver_label, round(corr(value, x), 6) as coefficient, round(power(corr(value, x), 2), 6) as r2, (sum(id) * 7 % 360)::double as wind from (select scope, id, value, unnest(['lat', 'lng', 'id']) as driver, unnest([lat, lng, id::double]) as x from geo) group by scope, driver)"


@query("geo", f"""with {DRIVERS}, b as (select *, row_number() over (partition by scope order by abs(coefficient) desc, driver) as r from a)
select scope, {ABOUT}, round(r2, 4) as model_score, wind as prevailing_wind_direction, driver as driver_key, driver_label, round(coefficient, 4) as standardized_coefficient, first_value(case when abs(coefficient) > 0 then driver end) over (partition by scope order by r) as dominant_driver, r as driver_rank from b""")
def export_drivers(spark, sf):
    rows = V.geo(spark, sf).select("scope", F.col("id").alias("n"), "value", F.col("id").cast("double").alias("id"), "lat", "lng").unpivot(["scope", "n", "value"], ["lat", "lng", "id"], "driver", "x")
    r = F.corr("value", "x")
    rows = rows.groupBy("scope", "driver").agg(S.rounded(r).alias("coefficient"), S.rounded(r * r).alias("r2"), (F.sum("n") * 7 % 360).cast("double").alias("wind"))
    rows = rows.withColumn("driver_label", F.concat(F.lit("driver "), "driver"))
    return L.driver_rows(rows, ["scope"], **FIXED)


# selection and series ------------------------------------------------------------------------------------------------
@query("meteo", "select station, day, temperature from (select station::varchar as station, day, temperature from meteo union all select 'modeled-' || station, day, temperature from meteo where station % 3 = 0)")
def meteo_replication(spark, sf):
    m = V.meteo(spark, sf).select(F.col("station").cast("string").alias("station"), "day", "temperature")
    ids = m.select("station").distinct().where("cast(station as int) % 3 = 0")
    return L.replicated(m, ids.select(F.concat(F.lit("modeled-"), "station").alias("id"), F.col("station").alias("source_id")))


@query("geo", "select station, radius_m, value from (select id::varchar as station, radius_m, id % 11 * radius_m as value from geo, (values (250), (500), (1000)) r(radius_m)) union all select 'modeled-' || id, radius_m, id % 11 * radius_m from geo, (values (250), (500), (1000)) r(radius_m) where id % 4 = 1")
def context_replication(spark, sf):
    radius = spark.createDataFrame([(250,), (500,), (1000,)], "radius_m int")
    m = V.geo(spark, sf).join(radius).select(F.col("id").cast("string").alias("station"), "radius_m", (F.col("id") % 11 * F.col("radius_m")).alias("value"))
    ids = V.geo(spark, sf).where("id % 4 = 1").select(F.concat(F.lit("modeled-"), F.col("id").cast("string")).alias("id"), F.col("id").cast("string").alias("source_id"))
    return L.replicated(m, ids)


@query("network_daily", f"""with {C.FILL}, n as (select pollutant, count(*) as n, avg(observed::int::double) as ratio from filled group by 1), h as (select unnest([7, 30]) as horizon_days)
select pollutant, horizon_days::bigint as horizon_days, n >= greatest(90, 3 * horizon_days) and ratio >= 0.75 as supported,
  case when n < greatest(90, 3 * horizon_days) then 'Forecast icin en az 90 gunluk gunluk seri gerekir.' when ratio < 0.75 then 'Forecast icin gunluk seri dolulugu en az %75 olmalidir.' end as unavailable_reason from n, h""")
def forecast_gates(spark, sf):
    return L.forecast_slices(C._filled(spark, sf), ["pollutant"]).select("pollutant", "horizon_days", "supported", "unavailable_reason")


@query()
def forecast_slices(spark, sf):
    return L.forecast_slices(C._filled(spark, sf), ["pollutant"])


@query("", f"with i as ({C.ORACLES['event_impact']}) select * from i where event_id = 2 order by (station = 5) desc, (status = 'exposed') desc, distance_km, station limit 6")
def event_impact_top(spark, sf):
    return L.impact_order(C.event_impact(spark, sf).where("event_id = 2"), 5)




@query("", """with e as (select page_id as event_id, case when page_id % 5 = 0 then 'NASA FIRMS' else 'curated' end as source, case when page_id % 7 > 0 then url else '' end as reference_url from pages)
select 0 as part, reference_url as url from (select distinct reference_url from e where reference_url <> '') union all select 1, 'https://firms.modaps.eosdis.nasa.gov/api/' from e having bool_or(source = 'NASA FIRMS')""")
def distinct_refs(spark, sf):
    p = V.table(spark, sf, "pages")
    source = F.when(F.col("page_id") % 5 == 0, "NASA FIRMS").otherwise("curated")
    return L.reference_urls(p.select(F.col("page_id").alias("event_id"), source.alias("source"), F.when(F.col("page_id") % 7 > 0, F.col("url")).otherwise("").alias("reference_url")))


@query("daily", """select 'gap-' || station as id, 'warning' as severity, pollutant as message from (select station, pollutant, count(distinct day) as n from daily group by all) where n < 28
  union all select 'modeled', 'info', 'modeled stations are estimates' union all select 'gap-' || station, 'error', 'no record' from range(25) t(station) where station not in (select station from daily)""")
def issue_lists(spark, sf):
    d = V.daily(spark, sf)
    gaps = d.groupBy("station", "pollutant").agg(F.countDistinct("day").alias("n")).where("n < 28").select(F.concat(F.lit("gap-"), F.col("station").cast("string")).alias("id"), F.lit("warning").alias("severity"), F.col("pollutant").alias("message"))
    none = spark.range(25).select(F.col("id").alias("station")).join(d.select("station").distinct(), "station", "left_anti").select(F.concat(F.lit("gap-"), F.col("station").cast("string")).alias("id"), F.lit("error").alias("severity"), F.lit("no record").alias("message"))
    info = spark.createDataFrame([("modeled", "info", "modeled stations are estimates")], "id string, severity string, message string")
    return L.issues(gaps, info, none)


@query("monthly", "select scope, method, count(*) filter (ok) as slices from (select case when pollutant < '3' then 'physical' else 'all' end as scope, case when month(month) % 2 = 0 then 'idw' else 'kriging' end as method, pollutant <> '5-LOW' and (month(month) % 2 = 0 or pollutant = '1-URGENT') as ok from monthly) group by all having bool_or(ok)")
def available_methods(spark, sf):
    even = F.month("month") % 2 == 0
    ok = (F.col("pollutant") != "5-LOW") & (even | (F.col("pollutant") == "1-URGENT"))
    rows = V.monthly(spark, sf).select(F.when(F.col("pollutant") < "3", "physical").otherwise("all").alias("scope"), F.when(even, "idw").otherwise("kriging").alias("method"), ok.alias("supported"))
    return L.methods(rows)


@query("geo", f"select id, case when id % 5 = 0 then '{L.MODELED}' end as reason from geo")
def modeled_selection(spark, sf):
    return V.geo(spark, sf).select("id", L.modeled_reason(F.when(F.col("id") % 5 == 0, "modeled").otherwise("official")).alias("reason"))


@query("monthly", """with s as (select pollutant as slice_id, list(case when month(month) <> 5 then value end order by month) as v, list((month(month) / 12.0)::double order by month) as e from monthly group by 1),
x as (select slice_id, unnest(v) as value, unnest(e) as exceedance, generate_subscripts(v, 1) - 1 as i from s)
select slice_id, 'c' || i as cell_id, value, round(value / max(value) over (partition by slice_id), 6) as load, exceedance from x where value is not null""")
def surface_value_arrays(spark, sf):
    m = V.monthly(spark, sf).withColumn("v", F.when(F.month("month") != 5, F.col("value"))).withColumn("e", F.month("month") / 12.0)
    at = F.array_sort(F.collect_list(F.struct("month", "v", "e")))
    s = m.groupBy(F.col("pollutant").alias("slice_id")).agg(at.alias("a")).select("slice_id", F.col("a.v").alias("values"), F.col("a.e").alias("exceedances"))
    cells = spark.range(400).select(F.col("id").cast("int").alias("i"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("cell_id"))
    return L.surface_values(s, cells).withColumn("load", S.rounded("load"))


@query("monthly", """select pollutant || strftime(month, '-%Y-%m') as slice_id, ok as supported, case when not ok then coalesce(failure, 'Yeterli sayida olculmus istasyon yok.') end as unavailable_reason, coalesce(n, 0)::bigint as eligible_station_count, 0.0::double as mean_completeness, case when ok and value < 150000 then value end as moran_i
from (select *, month(month) % 3 <> 0 as ok, case when month(month) = 3 then 'Bucket butunlugu' end as failure, case when month(month) < 9 then month(month) end as n from monthly)""")
def slice_normalise(spark, sf):
    m, k = V.monthly(spark, sf), F.month("month")
    rows = m.select(F.concat("pollutant", F.date_format("month", "-yyyy-MM")).alias("slice_id"), F.when(k % 3 != 0, "ok").otherwise("insufficient-observations").alias("status"), F.when(k == 3, "Bucket butunlugu").alias("failure"), F.when(k < 9, k).alias("station_count"), F.lit(None).cast("double").alias("mean_completeness"), F.when(F.col("value") < 150000, F.col("value")).otherwise(float("nan")).alias("moran_i"))
    return L.normalised(rows, {"moran_i": "double"})


@query("evt", f"""with {SLICES} select slice_id, kind, start_day, end_day from s where slice_id = 'event-2' union all select slice_id, kind, start_day, end_day from s where not exists (select 1 from s where slice_id = 'event-2') and kind = 'month' and end_day >= date '2024-01-10' and start_day <= date '2024-01-16'""")
def slice_choice(spark, sf):
    return L.overlapping_slice(_slices(spark, sf).select("slice_id", "kind", "start_day", "end_day"), "2024-01-10", "2024-01-16", "event-2", months=True)


RANGE = ("1997-01-10", "1997-05-20")
PACKAGE = f"""s as (select 'month' as kind, strftime(day, '%Y-%m') as slice_id, station, date_trunc('month', day)::date as start_day, last_day(day) as end_day, avg(value) as m from air_long group by all
  union all select 'event', 'event-' || event_id, station, start_day, end_day, avg(value) from air_long join evt on day between start_day and end_day group by all),
w as (select *, {V.overlap_sql('start_day', 'end_day', *RANGE)} as w from s), p as (select 'c' || c_nationkey as id, round(avg(c_acctbal) / 10000, 6) as proximity from customer group by 1)"""


def _package(spark, sf):
    m = F.trunc("day", "month")
    rows = V.air_long(spark, sf)
    months = rows.groupBy("station", m.alias("start_day")).agg(F.avg("value").alias("m")).select("station", F.date_format("start_day", "yyyy-MM").alias("slice_id"), F.lit("month").alias("kind"), "start_day", F.last_day("start_day").alias("end_day"), "m")
    events = R.event_slices(rows, V.evt(spark, sf), ["station"]).select("station", "slice_id", "kind", "start_day", "end_day", F.col("value").alias("m"))
    s = months.unionByName(events).withColumn("scope", F.lit("physical"))
    slices = ["slice_id", "kind", "start_day", "end_day", "scope"]
    cell = F.concat(F.lit("c"), F.col("station").cast("string")).alias("cell_id")
    cells = s.select(cell).distinct()
    return {
        "surfaces": s.select(*slices, cell, F.lit("idw").alias("method"), F.col("m").alias("value"), (F.col("m") / 300000).alias("exceedance")),
        "stats": s.select(*slices, "station", ((F.col("m") - 150000) / 20000).alias("z"), (F.col("m") / 1000000).alias("p_value")),
        "risks": s.select(*slices, cell, (F.col("m") / 250000).alias("score"), (F.col("m") / 300000).alias("pollution")),
        "drivers": s.select(*slices, F.col("station").alias("driver"), (F.col("m") / 100000).alias("coefficient"), F.lit(10).alias("n"), F.lit(90.0).alias("wind")),
        "forecasts": spark.createDataFrame([("physical", True), ("all", False)], "scope string, supported boolean"),
        "contexts": V.table(spark, sf, "customer").groupBy(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("cell_id")).agg(S.rounded(F.avg("c_acctbal") / 10000).alias("proximity_index")),
        "cells": cells,
    }


@query("air_long evt", f"""with {PACKAGE}, c as (select 'c' || station as id, round(sum(m * w) filter (kind = 'month') / sum(w) filter (kind = 'month'), 6) as v, round(sum((m - 150000) / 20000 * w) / sum(w), 6) as z, round(sum(m / 250000 * w) / sum(w), 6) as score from w where w > 0 group by station)
select * from (select 'top_polluted' as part, id, v as value from c order by v desc, id limit 6) union all select * from (select 'cleanest', id, v from c order by v, id limit 6)
union all select * from (select 'top_hotspots', id[2:], z from c where z > 0 order by z desc, id limit 8) union all select * from (select 'top_coldspots', id[2:], z from c where z < 0 order by z, id limit 8)
union all select * from (select 'top_risks', id, score from c order by score desc, id limit 10) union all select * from (select 'highest_proximity', id, proximity from p where id in (select 'c' || station from s) order by proximity desc, id limit 8)""")
def resolve_range(spark, sf):
    out = None
    tables = L.resolved(_package(spark, sf), L.Request(*RANGE, method="kriging"))
    for part, key, value in (("top_polluted", "cell_id", "value"), ("cleanest", "cell_id", "value"), ("top_hotspots", "station", "z"), ("top_coldspots", "station", "z"), ("top_risks", "cell_id", "score"), ("highest_proximity", "cell_id", "proximity_index")):
        rows = tables[part].select(F.lit(part).alias("part"), F.col(key).cast("string").alias("id"), S.rounded(value).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("air_long evt", f"with {PACKAGE} select 'c' || station as cell_id, round(m, 6) as value from s where slice_id = '1998-09' order by m desc, cell_id limit 6")
def resolve_slice(spark, sf):
    tables = L.resolved(_package(spark, sf), L.Request(*RANGE, slice_id="1998-09"))
    return tables["top_polluted"].select("cell_id", S.rounded("value").alias("value"))


@query("", f"""with c as ({C.ORACLES["cell_context"]}), w as ({C.ORACLES["wind_alignment"]}), f as ({C.ORACLES["idw_surface"]})
select c.cell_id, value, road_density, round(greatest(0, 1 - coalesce(nearest_industry_m, 0) / 5000), 6)::double as industry_proximity, green_ratio, impervious_ratio, elevation, slope, alignment as wind_alignment from c join w on c.cell_id = w.cell_id join f on f.cell_id = c.cell_id and scope = 0""")
def driver_matrix(spark, sf):
    cells = X.grid(spark, *C.GRID)
    values = X.idw(cells, V.geo(spark, sf).where("scope = 0")).withColumn("value", F.round("value", 4))
    industries = V.geo(spark, sf).where("scope = 1").select(F.col("id").cast("string").alias("id"), "lat", "lng")
    return r6(L.driver_matrix(values, cells, A._contexts(spark, sf), industries, 225.0))


@query()
def source_summaries(spark, sf):
    cells = X.grid(spark, *C.GRID)
    industries = V.geo(spark, sf).where("scope = 1").select(F.col("id").cast("string").alias("id"), "lat", "lng")
    return L.source_summaries(L.driver_matrix(X.idw(cells, V.geo(spark, sf), ["scope"]), cells, A._contexts(spark, sf), industries, 225.0), ["scope"])


@query("geo", """with r as (select id, unnest(range(0, id % 3 + 1)) as k from geo), a as (select id, k, ((k * 7 + id) % 5 + 1)::double as side from r), m as (select id, arg_max(k, (side, -k)) as k, max(side) as side from a group by id)
select id, k::bigint as ring, (k + side / 2)::double as x, (side / 2)::double as y from m""")
def ring_ops(spark, sf):
    def ring(k):
        side = ((k * 7 + F.col("id")) % 5 + 1).cast("double")
        corner = lambda x, y: F.struct((k + x * side).alias("x"), (y * side).alias("y"))
        return F.array(corner(0.0, 0.0), corner(1.0, 0.0), corner(1.0, 1.0), corner(0.0, 1.0), corner(0.0, 0.0))

    rings = V.geo(spark, sf).select("id", F.transform(F.sequence(F.lit(0).cast("long"), F.col("id") % 3), ring).alias("rings"))
    out = rings.select("id", G.largest_ring("rings").alias("ring")).select("id", "ring", G.vertex_centroid("ring").alias("c"))
    return out.select("id", F.element_at("ring", 1)["x"].cast("long").alias("ring"), "c.x", "c.y")
