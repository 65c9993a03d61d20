"""More queries by name, each with its SQL: labels, map layers, slices and their merging, analyses, rows for export."""

from __future__ import annotations

from pyspark.sql import functions as F

from windrow.functions import labels as L
from windrow.functions import scalars as S
from windrow.operators import explorer as W
from windrow.operators import forecast as P
from windrow.operators import grids as B
from windrow.operators import layers as Y
from windrow.operators import results as R
from windrow.operators import spatial as X
from windrow.operators import temporal as T
from windrow.operators.tables import written
from windrow.plans import catalogue as C
from windrow.plans import views as V
from windrow.plans.catalogue import GRID, GRID_SQL, query, r6
from windrow.sources import landed


# labels --------------------------------------------------------------------------------------------------------------
@query("", """select event_id, case 1001 + event_id % 4 when 1001 then 'traffic' when 1002 then 'industrial'
  when 1003 then case 2000 + event_id % 3 when 2000 then 'rural-background' when 2002 then 'suburban-background' else 'urban-background' end
  else case 2000 + event_id % 3 when 2000 then 'rural' when 2002 then 'suburban' else 'urban' end end as station_type,
  (['Resmi belediye', 'Sensör ağı', 'Model', 'Resmî'])[event_id % 4 + 1] as badge,
  case when value >= 70 then 'Yuksek baski' when value >= 45 then 'Orta baski' else 'Dusuk baski' end as pressure,
  case when value >= 75 then 'Cok yuksek' when value >= 55 then 'Yuksek' when value >= 35 then 'Orta' else 'Dusuk' end as risk from events""")
def scalars_labels(spark, sf):
    i = F.col("event_id")
    source = F.element_at(F.array(F.lit("municipal-official"), F.lit("municipal-sensor"), F.lit("modeled"), F.lit(None).cast("string")), (i % 4 + 1).cast("int"))
    pressure = S.banded("value", (70, 45), ("Yuksek baski", "Orta baski", "Dusuk baski"))
    return V.table(spark, sf, "events").select("event_id", L.station_type((i % 4 + 1001).cast("int"), (i % 3 + 2000).cast("int")).alias("station_type"), L.source_badge(source).alias("badge"), pressure.alias("pressure"), S.risk_label(F.col("value") / 100).alias("risk"))


@query("", """select n_nationkey, n_name as district, case when n_nationkey % 2 = 0 then n_name when n_nationkey % 3 <> 0 then 'T / ' || n_name else n_name end as sensor,
  case when n_nationkey % 2 = 0 then 'PM2.5' else 'NO2' end as pollutant,
  abs(list_reduce(list_concat([0::bigint], list_transform(range(1, len(n_name) + 1), lambda i: ascii(n_name[i])::bigint)), lambda h, c: (((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648)) as hash from nation""")
def scalars_text(spark, sf):
    k, name = F.col("n_nationkey"), F.col("n_name")
    title = F.concat(F.lit("Bursa - "), name, F.when(k % 3 == 0, " (Merkez)").otherwise("-MTHM"))
    sensor = L.sensor_name(F.concat(name, F.when(k % 2 == 0, " - AQ1").otherwise("")), F.when(k % 3 != 0, "T"))
    return V.table(spark, sf, "nation").select("n_nationkey", L.district(title).alias("district"), sensor.alias("sensor"), L.pollutant_name(F.when(k % 2 == 0, "PM25").otherwise("NO2")).alias("pollutant"), L.string_hash(name).alias("hash"))


@query("", """select event_id, (ts::date - interval 1 year)::date as year_before, strftime(ts, '%d.%m.%Y %H:00') as official, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' as utc, ts::date - 7 as window_start, ts::date + 17 as window_end,
  strftime(ts, '%d') || ' ' || (['Oca', 'Şub', 'Mar', 'Nis', 'May', 'Haz', 'Tem', 'Ağu', 'Eyl', 'Eki', 'Kas', 'Ara'])[month(ts)] || ' ' || year(ts)::varchar as label, 4::bigint as days from events""")
def scalars_time(spark, sf):
    day = F.to_date("ts")
    start, end = L.event_window(day, F.date_add(day, 3))
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return V.table(spark, sf, "events").select("event_id", L.years_back(day, 1).alias("year_before"), L.official_time("ts").alias("official"), L.utc_text(text).alias("utc"), start.alias("window_start"), end.alias("window_end"), L.day_label(day).alias("label"), S.inclusive_days(day, F.date_add(day, 3)).cast("long").alias("days"))


@query("", """select s_suppkey, translate(format('{:,.1f}', s_acctbal::double), ',.', '.,') as number, '%' || translate(format('{:,.0f}', s_acctbal::double / 100), ',.', '.,') as share,
  case when s_acctbal > 0 then '+' else '' end || translate(format('{:,.2f}', s_acctbal::double), ',.', '.,') as signed, round(sin(s_suppkey * 12.9898::double) * 43758.5453123::double - floor(sin(s_suppkey * 12.9898::double) * 43758.5453123::double), 6) as noise from supplier""")
def scalars_formats(spark, sf):
    v = F.col("s_acctbal").cast("double")
    return r6(V.table(spark, sf, "supplier").select("s_suppkey", S.formatted(v, 1).alias("number"), L.percent(v / 10000).alias("share"), L.signed(v, 2).alias("signed"), L.noise("s_suppkey").alias("noise")))


@query("", """select event_id, round(0.18 + 0.82 * greatest(0, least(1, value / 78.0::double)), 6)::double as intensity, round((56 + 118 * greatest(0, least(1, value / 78.0::double))) * case event_id % 2 when 0 then 1 else 0.82 end, 6)::double as radius from events""")
def map_spread(spark, sf):
    intensity, radius = L.spread("value", 50.0, F.when(F.col("event_id") % 2 == 1, "modeled"))
    return r6(V.table(spark, sf, "events").select("event_id", intensity.alias("intensity"), radius.alias("radius")))


@query("", "select s_suppkey, 'node-' || s_suppkey % 7 || case when i > 1 then '-' || i else '' end as slug from (select s_suppkey, row_number() over (partition by s_suppkey % 7 order by s_suppkey) as i from supplier)")
def station_references(spark, sf):
    t = V.table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("Node "), (F.col("s_suppkey") % 7).cast("string")).alias("title"))
    return R.unique_slugs(t, "title", "s_suppkey").select("s_suppkey", "slug")


@query("air", "select pollutant, count(*) as n, count(distinct station) as stations from air group by pollutant")
def source_counts(spark, sf):
    return V.air(spark, sf).groupBy("pollutant").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("station").alias("stations"))


@query("geo", "select scope, id, round(value, 6) as value from geo order by scope desc, value desc nulls last, id limit 12")
def orderings(spark, sf):
    return r6(V.geo(spark, sf).select("scope", "id", "value").orderBy(F.desc("scope"), F.desc_nulls_last("value"), "id").limit(12))


# layers --------------------------------------------------------------------------------------------------------------
@query("", "with e as (select min(l_shipdate)::date as lo, max(l_shipdate)::date as hi from lineitem), s as (select hi, unnest(generate_series(lo, hi, interval 90 days))::date as s from e) select s as start_day, least(s + 89, hi) as end_day from s")
def rolling_windows(spark, sf):
    days = V.table(spark, sf, "lineitem").agg(F.to_date(F.min("l_shipdate")).alias("start_day"), F.to_date(F.max("l_shipdate")).alias("end_day"))
    return landed.spans(days, landed.SENSOR_DAYS).select("start_day", "end_day")


@query("geo", """with d as (select id, lat, lng, unnest(range(-45, 360, 45)) as angle, 350.0::double / 6371000 as d from geo),
q as (select *, asin(sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(radians(angle))) as lat2 from d)
select id, (angle / 45 + 1)::bigint as sample, round(case when angle < 0 then lat else degrees(lat2) end, 6) as lat,
  round(case when angle < 0 then lng else degrees(radians(lng) + atan2(sin(radians(angle)) * sin(d) * cos(radians(lat)), cos(d) - sin(radians(lat)) * sin(lat2))) end, 6) as lng from q""")
def radius_samples(spark, sf):
    return r6(Y.radius_samples(V.geo(spark, sf), 500.0))


@query("geo", f"""select id, metres, reference, value from (select *, row_number() over (partition by id order by metres, reference) as r from
  (select g.id, round({V.haversine('g.lat', 'g.lng', 'r.lat', 'r.lng')}, 3) as metres, r.id as reference, r.value from geo g join geo r on r.scope = 0 and g.id <> r.id)) where r = 1""")
def nearest_reference_station(spark, sf):
    g = V.geo(spark, sf)
    return r6(Y.donated(g, g.where("scope = 0"), ["value"]))


@query("geo", f"select 1::bigint as area, count(*) as n, string_agg(id::varchar, ',' order by id) as members from (select id from geo, {C._SIDES} group by id having count(*) filter ((y1 > lat) <> (y2 > lat) and lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1)")
def area_members(spark, sf):
    m = Y.members(spark.range(1, 2).select(F.col("id").alias("area"), C._ring().alias("ring")), V.geo(spark, sf))
    return m.select("area", F.size("members").cast("long").alias("n"), F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query("geo", f"""with d as (select p.id, f.id * 10.0::double as area, {V.haversine('p.lat', 'p.lng', 'f.lat', 'f.lng')} as d from geo p join geo f on p.scope = 0 and f.scope <> 0),
r as (select p.id, r.radius from (select id from geo where scope = 0) p, (select unnest([5000, 10000, 20000])::bigint as radius) r)
select r.id, r.radius, count(d.area) as features, round(coalesce(sum(d.area), 0), 6)::double as area from r left join d on r.id = d.id and d.d <= r.radius group by r.id, r.radius""")
def buffer_metrics(spark, sf):
    g = V.geo(spark, sf)
    return r6(Y.buffers(g.where("scope = 0"), g.where("scope <> 0").select("lat", "lng", (F.col("id") * 10.0).alias("area")), (5000, 10000, 20000)))


ORIGIN = (40.175, 28.99)


def _x(lng: str) -> str:
    return f"(radians({lng} - 28.99) * cos(radians(40.175)) * 6371000.0)"


def _y(lat: str) -> str:
    return f"(radians({lat} - 40.175) * 6371000.0)"


def _lines(spark, sf, g=None):
    g = V.geo(spark, sf) if g is None else g
    point = lambda dlat, dlng: F.struct((F.col("lat") + dlat).alias("lat"), (F.col("lng") + dlng).alias("lng"))
    return g.select("id", F.when(F.col("id") % 2 == 0, "primary").otherwise("path").alias("category"), F.array(point(0.0, 0.0), point(0.01, 0.02), point(0.03, 0.0)).alias("path"))


LINES = """s as (select id, case when id % 2 = 0 then 'primary' else 'path' end as category, i, lat + [0.0::double, 0.01::double][i + 1] as lat1, lng + [0.0::double, 0.02::double][i + 1] as lng1,
  lat + [0.01::double, 0.03::double][i + 1] as lat2, lng + [0.02::double, 0.0::double][i + 1] as lng2 from geo, (select unnest([0, 1])::bigint as i))"""


@query("geo", f"with {LINES} select id, category, i, round({V.haversine('lat1', 'lng1', 'lat2', 'lng2')}, 4) as metres from s")
def polyline_segments(spark, sf):
    return r6(Y.segments(_lines(spark, sf)).select("id", "category", "i", F.round("metres", 4).alias("metres")))


@query("geo", f"with {LINES} select id, round(sum({V.haversine('lat1', 'lng1', 'lat2', 'lng2')}), 4) as metres from s group by id")
def polyline_length(spark, sf):
    return _lines(spark, sf).select("id", F.round(Y.line_length("path"), 4).alias("metres"))


@query("geo", f"select id, round(power(radians(0.02::double) * 6371000, 2) * cos(radians(40.175::double)), 2)::double as area, round({_x('lng')}, 3) as cx, round({_y('lat')}, 3) as cy from geo")
def polygon_features(spark, sf):
    corner = lambda a, b: F.struct((F.col("lat") + a).alias("lat"), (F.col("lng") + b).alias("lng"))
    ring = F.array(*[corner(a, b) for a, b in ((-0.01, -0.01), (0.01, -0.01), (0.01, 0.01), (-0.01, 0.01), (-0.01, -0.01))])
    p = Y.polygons(V.geo(spark, sf).select("id", ring.alias("ring")), "ring", *ORIGIN)
    return p.select("id", F.round("area", 2).alias("area"), F.round("cx", 3).alias("cx"), F.round("cy", 3).alias("cy"))


@query("geo", "select round(min(lat) - 0.05, 6) as south, round(min(lng) - 0.05, 6) as west, round(max(lat) + 0.05, 6) as north, round(max(lng) + 0.05, 6) as east from geo")
def bbox_extent(spark, sf):
    return r6(Y.extent(V.geo(spark, sf)))


BOUNDARY = """b as (select scope, avg(lat) as la, avg(lng) as ln, min(lat) as s, max(lat) as n, min(lng) as w, max(lng) as e from geo where scope < 2 group by scope),
c as (select scope, 0 as hole, [ln, e, ln, w] as x, [s, la, n, la] as y from b union all select scope, 1, [ln - 0.05, ln + 0.05, ln + 0.05, ln - 0.05], [la - 0.05, la - 0.05, la + 0.05, la + 0.05] from b),
e as (select scope, hole, x[i] as x1, y[i] as y1, x[i % 4 + 1] as x2, y[i % 4 + 1] as y2 from c, range(1, 5) t(i))"""


def _boundary(spark, sf):
    """Two lozenges with a square hole each, from the extents of two scopes' places."""
    b = V.geo(spark, sf).where("scope < 2").groupBy("scope").agg(F.avg("lat").alias("la"), F.avg("lng").alias("ln"), F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lng").alias("w"), F.max("lng").alias("e"))
    ring = lambda *at: F.array(*[F.struct(F.expr(x).alias("x"), F.expr(y).alias("y")) for x, y in at])
    outline, hole = ring(("ln", "s"), ("e", "la"), ("ln", "n"), ("w", "la")), ring(("ln - 0.05", "la - 0.05"), ("ln + 0.05", "la - 0.05"), ("ln + 0.05", "la + 0.05"), ("ln - 0.05", "la + 0.05"))
    return b.select(F.array(outline, hole).alias("rings"))


@query("geo", f"""with {BOUNDARY}, x as (select round(min(y1), 6) as south, round(min(x1), 6) as west, round(max(y1), 6) as north, round(max(x1), 6) as east from e),
d as (select *, 5 / 110.574::double as dlat, 5 / (111.32::double * greatest(cos(radians((south + north) / 2)), 0.25)) as dlng from x),
r as (select *, unnest(range(0, floor((north - south - dlat / 2) / dlat)::bigint + 1)) as row from d), q as (select *, unnest(range(0, floor((east - west - dlng / 2) / dlng)::bigint + 1)) as col from r),
g as (select *, south + dlat / 2 + row * dlat as lat, west + dlng / 2 + col * dlng as lng from q),
h as (select row, col, scope, hole, count(*) filter ((y1 > lat) <> (y2 > lat) and lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1 as hit from g, e group by all),
k as (select row, col from h o where hole = 0 and hit and not exists (select 1 from h i where i.row = o.row and i.col = o.col and i.scope = o.scope and i.hole = 1 and i.hit) group by all)
select format('r{{:03d}}c{{:03d}}', row, col) as cell_id, row, col, round(lat, 6) as lat, round(lng, 6) as lng, round(radians(lng - west) * cos(radians(south)) * 6371000, 3) as x, round(radians(lat - south) * 6371000, 3) as y,
  round(lng - dlng / 2, 6) as ring_west, round(lat - dlat / 2, 6) as ring_south, round(lng + dlng / 2, 6) as ring_east, round(lat + dlat / 2, 6) as ring_north from g join k using (row, col)""")
def clipped_grid(spark, sf):
    out = B.clipped(_boundary(spark, sf), V.geo(spark, sf))
    corner = lambda i, c: S.rounded(F.col("ring")[i][c])
    out = out.select("cell_id", "row", "col", S.rounded("lat").alias("lat"), S.rounded("lng").alias("lng"), "x", "y", corner(0, "x").alias("ring_west"), corner(0, "y").alias("ring_south"), corner(2, "x").alias("ring_east"), corner(2, "y").alias("ring_north"))
    return out


RADII = (2500, 5000, 10000)
KIND_OF = {1: "building", 2: "green", 3: "industry"}


@query("geo", f"""with {LINES}, w as (select id, category, (lat1 + lat2) / 2 as lat, (lng1 + lng2) / 2 as lng, {V.haversine('lat1', 'lng1', 'lat2', 'lng2')} as metres from s),
f as (select case scope when 1 then 'building' when 2 then 'green' else 'industry' end as kind, lat, lng, case when scope = 3 and id % 8 = 3 then 0 else id * 20000.0::double end as area, 0.0::double as length from geo where scope > 0
  union all select 'road', lat, lng, metres * case category when 'primary' then 12.0::double else 6.0::double end, metres from w),
d as (select p.id, f.kind, area, length, {V.haversine('p.lat', 'p.lng', 'f.lat', 'f.lng')} as d from geo p, f where p.scope = 0),
r as (select id, radius, pi() * radius * radius as circle from geo, (select unnest([2500, 5000, 10000])::bigint as radius) where scope = 0),
a as (select r.id, r.radius, any_value(circle) as circle, coalesce(sum(area) filter (kind = 'building'), 0) as b, coalesce(sum(area) filter (kind = 'green'), 0) as g, coalesce(sum(area) filter (kind = 'industry'), 0) as i, coalesce(sum(area) filter (kind = 'road'), 0) as w, coalesce(sum(length), 0) as l, count(*) filter (kind = 'industry') as n
  from r left join d on r.id = d.id and d <= radius group by r.id, r.radius),
h as (select id, radius, sample, ((id * 13 + sample * 7 + radius // 100) % 900)::double as e from r, range(9) t(sample)), m as (select h.id, h.radius, avg(h.e) as mean, avg(degrees(atan(abs(h.e - o.e) / (h.radius * 0.7::double)))) filter (h.sample > 0) as slope from h join h o on h.id = o.id and h.radius = o.radius and o.sample = 0 group by h.id, h.radius)
select a.id, a.radius, round(b / circle, 4)::double as building_density, round(l / 1000 / (circle / 1000000), 4)::double as road_density, round(least(1, g / circle), 4)::double as green_ratio, round(least(1, (b + i + w) / circle), 4)::double as impervious_ratio, n as industry_count, round(mean, 2) as mean_elevation, round(slope, 2) as slope_mean from a join m on a.id = m.id and a.radius = m.radius""")
def station_buffers(spark, sf):
    g = V.geo(spark, sf)
    kind = F.create_map(*[F.lit(x) for pair in KIND_OF.items() for x in pair])[F.col("scope").cast("int")]
    places = g.where("scope > 0").select(kind.alias("kind"), "lat", "lng", F.when((F.col("scope") == 3) & (F.col("id") % 8 == 3), F.lit(None)).otherwise(F.col("id") * 20000.0).alias("area"), F.lit(None).cast("double").alias("length"))
    stations = g.where("scope = 0")
    each = stations.select("id", F.explode(F.array(*map(F.lit, RADII))).alias("radius"), F.sequence(F.lit(0), F.lit(8)).alias("samples")).select("id", "radius", F.explode("samples").alias("sample"))
    heights = each.withColumn("elevation", ((F.col("id") * 13 + F.col("sample") * 7 + F.floor(F.col("radius") / 100)) % 900).cast("double"))
    return Y.station_buffers(stations, places.unionByName(Y.road_features(Y.segments(_lines(spark, sf)))), heights, RADII)


WIDTHS_SQL = "case category when 'primary' then 12.0::double else 6.0::double end"
CTX = f"""{GRID_SQL}, {LINES}, c as (select cell_id, {_x('lng')} as x, {_y('lat')} as y from g),
r as (select *, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) as length from (select {_x('lng1')} as x1, {_y('lat1')} as y1, {_x('lng2')} as x2, {_y('lat2')} as y2, {WIDTHS_SQL} as width from s)),
t as (select *, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (length * length))) as t from c, r),
road as (select cell_id, min(sqrt(power(x - x1 - t * (x2 - x1), 2) + power(y - y1 - t * (y2 - y1), 2))) as m, sum(case when near then length else 0 end) as length, sum(case when near then length * width else 0 end) as area
  from (select *, sqrt(power(x - (x1 + x2) / 2, 2) + power(y - (y1 + y2) / 2, 2)) <= 3000 as near from t) group by cell_id),
p as (select scope, id, {_x('lng')} as px, {_y('lat')} as py from geo), d as (select cell_id, scope, id, sqrt(power(x - px, 2) + power(y - py, 2)) as d from c, p),
o as (select cell_id, min(d) filter (scope = 1) as m, count(*) filter (scope = 1 and d <= 3000) as n, coalesce(sum(id * 100000.0::double) filter (scope = 2 and d <= 3000), 0) as green,
  sum((id * 13 % 900) / power(greatest(d, 1.0), 2)) filter (scope = 3) / sum(1 / power(greatest(d, 1.0), 2)) filter (scope = 3) as height from d group by cell_id),
w as (select d.cell_id, avg(abs(id * 13 % 900 - height) / greatest(d, 1.0)) as slope from d join o on d.cell_id = o.cell_id where scope = 3 group by d.cell_id),
k as (select road.cell_id, road.m as rm, o.m as im, road.length / 1000 / (pi() * 9) as density, green, area, n, height, slope from road join o on road.cell_id = o.cell_id join w on w.cell_id = o.cell_id),
ctx as (select cell_id, round(rm, 2) as nearest_road_m, round(im, 2) as nearest_industry_m, round(density, 4) as road_density, round(least(1, green / (pi() * 9000000)), 4)::double as green_ratio, round(least(1, (area + 400 * n) / (pi() * 9000000)), 4)::double as impervious_ratio,
  n as industry_count, round(0.45 * greatest(0, 1 - rm / 5000) + 0.35 * greatest(0, 1 - im / 5000) + 0.2 * least(density / 4, 1), 4)::double as proximity_index, round(height, 2) as elevation, round(slope, 2) as slope from k)"""


def _contexts(spark, sf):
    g = written(V.geo(spark, sf), "places")  # all layers are made of it
    of = lambda k: g.where(F.col("scope") == k)
    greens, heights = of(2).withColumn("area", F.col("id") * 100000.0), of(3).withColumn("height", (F.col("id") * 13 % 900).cast("double"))
    return Y.cell_contexts(X.grid(spark, *GRID), Y.segments(_lines(spark, sf, g)), of(1), greens, heights, ORIGIN)


@query("geo", f"with {CTX} select * from ctx")
def cell_context(spark, sf):
    return _contexts(spark, sf)


@query("geo", f"""with {GRID_SQL}, h as (select lat, lng, (value - avg(value) over ()) / stddev_samp(value) over () as z from geo),
x as (select cell_id, greatest({V.haversine('g.lat', 'g.lng', 'h.lat', 'h.lng')}, 1.0) as d, least(1, z / 2.58) as s from g, h where z > 0)
select g.cell_id, round(coalesce(sum(s / (d * d)) filter (d <= 10000) / sum(1 / (d * d)) filter (d <= 10000), 0), 6)::double as component from g left join x on g.cell_id = x.cell_id group by g.cell_id""")
def hotspot_component(spark, sf):
    g = V.geo(spark, sf)
    s = g.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    return r6(Y.hotspot_component(X.grid(spark, *GRID).select("cell_id", "lat", "lng"), g.join(s).select("lat", "lng", ((F.col("value") - F.col("m")) / F.col("sd")).alias("z"))))


@query("geo", f"""with {GRID_SQL}, n as (select cell_id, s.lat, s.lng, e.id, e.lat as elat, e.lng as elng, round({V.haversine('s.lat', 's.lng', 'e.lat', 'e.lng')}, 3) as m from g s, geo e where e.scope = 1),
b as (select * from (select *, row_number() over (partition by cell_id order by m, id::varchar) as r from n) where r = 1), e as (select cell_id, id, m, cos(radians({C.BEARING.replace('e.lat', 'elat').replace('e.lng', 'elng').replace('s.lat', 'lat').replace('s.lng', 'lng')} - 45)) as a from b)
select cell_id, id as industry, round(case when m <= 10000 then greatest(0, a) else 0 end, 6)::double as alignment from e""")
def wind_alignment(spark, sf):
    g = V.geo(spark, sf).where("scope = 1").select(F.col("id").cast("string").alias("id"), "lat", "lng")
    out = Y.wind_alignment(X.grid(spark, *GRID).select("cell_id", "lat", "lng"), g, 225.0)
    return r6(out.withColumn("industry", F.col("industry").cast("long")))


@query("geo", f"""with {C.DIST}, k as (select scope, metres, row_number() over (partition by scope order by metres) as i, count(*) over (partition by scope) as n, max(metres) over (partition by scope) as most from d where metres > 0),
v as (select scope, greatest(var_samp(value), 1e-6) as sill from geo group by scope)
select k.scope, round(0.05 * sill, 3)::double as nugget, round(sill, 3) as sill, round(greatest(1000, least(most, 1.75 * metres)), 3)::double as range_m from k join v on k.scope = v.scope where i = n // 2 + 1""")
def variogram(spark, sf):
    v = Y.variogram(V.geo(spark, sf), ["scope"])
    return v.select("scope", *[F.round(c, 3).alias(c) for c in ("nugget", "sill", "range_m")])


# slices and merges ---------------------------------------------------------------------------------------------------
@query("air_long", "select 'month-' || strftime(day, '%Y-%m') as slice_id, 'month' as kind, date_trunc('month', day)::date as start_day, last_day(day) as end_day, pollutant, round(avg(value), 6) as value, count(distinct day) as days from air_long group by all")
def month_slices(spark, sf):
    return r6(R.month_slices(V.air_long(spark, sf), ["pollutant"]))


@query("air_long evt", "select 'event-' || event_id as slice_id, 'event' as kind, start_day, end_day, pollutant, round(avg(value), 6) as value, count(distinct day) as days from air_long join evt on day between start_day and end_day group by all")
def event_slices(spark, sf):
    return r6(R.event_slices(V.air_long(spark, sf), V.evt(spark, sf), ["pollutant"]))


SLICES = "s as (select station, date_trunc('month', day)::date as start_day, last_day(day) as end_day, avg(value) as m from air_long group by all), w as (select *, greatest(least(end_day, date '1997-05-20') - greatest(start_day, date '1997-01-10') + 1, 0) as w from s)"
RANGE = ("1997-01-10", "1997-05-20")


def _slices(spark, sf):
    m = F.trunc("day", "month")
    return V.air_long(spark, sf).groupBy("station", m.alias("start_day")).agg(F.avg("value").alias("m")).withColumn("end_day", F.last_day("start_day"))


@query("air_long", f"""with {SLICES}, z as (select station, round(sum((m - 150000) / 20000 * w) / sum(w), 6) as z, round(sum(m / 1000000 * w) / sum(w), 6) as p_value, sum(w)::bigint as days, count(*) as slices from w where w > 0 group by station)
select *, case when z >= 2.58 then 'hotspot-99' when z >= 1.96 then 'hotspot-95' when z >= 1.65 then 'hotspot-90' when z <= -2.58 then 'coldspot-99' when z <= -1.96 then 'coldspot-95' when z <= -1.65 then 'coldspot-90' else 'not-significant' end as class from z""")
def merge_stats(spark, sf):
    s = _slices(spark, sf).withColumns({"z": (F.col("m") - 150000) / 20000, "p_value": F.col("m") / 1000000})
    return r6(R.merged_stats(s, ["station"], *RANGE)).withColumn("station", F.col("station").cast("int"))


@query("air_long", f"""with {SLICES}, z as (select station, round(sum(m / 250000 * w) / sum(w), 6) as score, round(sum(m / 300000 * w) / sum(w), 6) as pollution, sum(w)::bigint as days, count(*) as slices from w where w > 0 group by station)
select *, case when score >= 0.75 then 'Cok yuksek' when score >= 0.55 then 'Yuksek' when score >= 0.35 then 'Orta' else 'Dusuk' end as label from z""")
def merge_risk(spark, sf):
    s = _slices(spark, sf).withColumns({"score": F.col("m") / 250000, "pollution": F.col("m") / 300000})
    return r6(R.merged_risk(s, ["station"], ["pollution"], *RANGE)).withColumn("station", F.col("station").cast("int"))


@query("air_long", f"""with {SLICES}, x as (select *, ((station * 37 + month(start_day) * 50) % 360)::double as wind from w where w > 0)
select station, round(sum(m / 100000 * w) / sum(w), 6) as coefficient, (10 * count(*))::bigint as n, round((degrees(atan2(sum(sin(radians(wind)) * w), sum(cos(radians(wind)) * w))) % 360 + 360) % 360, 6) as wind from x group by station""")
def merge_drivers(spark, sf):
    s = _slices(spark, sf).withColumns({"coefficient": F.col("m") / 100000, "n": F.lit(10), "wind": ((F.col("station") * 37 + F.month("start_day") * 50) % 360).cast("double")})
    return r6(R.merged_drivers(s, ["station"], *RANGE)).withColumn("station", F.col("station").cast("int"))


# analyses and export -------------------------------------------------------------------------------------------------
@query("evt", "select event_id, kind from evt where end_day >= date '2024-01-10' and start_day <= date '2024-01-16' order by event_id limit 1")
def event_pick(spark, sf):
    return R.picked_event(V.evt(spark, sf), R.Filters("PM10", start="2024-01-10", end="2024-01-16")).select("event_id", "kind")


FILTERS = R.Filters("1-URGENT", start="1998-12-31", end="1996-01-01")


def _analysis(spark, sf):
    return R.analyze(V.air_long(spark, sf).withColumn("source", F.lit("official")), FILTERS, 150000.0)


OWN = """h as (select * from air_long where pollutant = '1-URGENT'), own as (select * from h where day between date '1996-01-01' and date '1998-12-31'),
om as (select date_trunc('month', day)::date as month, avg(value) as value from own group by 1), hm as (select date_trunc('month', day)::date as month, avg(value) as value from h group by 1)"""


@query("air_long", f"""with {OWN}, z as (select month, coalesce((value - avg(value) over q) / nullif(stddev_samp(value) over q, 0), 0) as z from hm window q as (partition by month(month))),
a as (select avg(z) as anomaly from z where month in (select month from om)), e as (select count(*) filter (v > 150000) as exceedance_days from (select day, avg(value) as v from own group by day)),
w as (select coalesce(avg(value) filter (dayofweek(day) not in (6, 0)), 0) - coalesce(avg(value) filter (dayofweek(day) in (6, 0)), 0) as weekday_difference from own),
n as (select value, row_number() over (order by month) as i from om), p as (select sign(b.value - a.value) as s, (b.value - a.value) / (b.i - a.i) as slope from n a join n b on a.i < b.i),
k as (select sum(s) as s, count(*) as m, median(slope) as slope, (select count(*)::double from n) as n from p), y as (select *, case when s > 0 then (s - 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18) when s < 0 then (s + 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18) else 0 end as z from k)
select '1-URGENT' as pollutant, round((select avg(value) from om), 6) as mean, round(anomaly, 6) as anomaly, exceedance_days, round(weekday_difference, 6) as weekday_difference, round(slope, 6) as slope, round(s / m, 6)::double as tau, round({C.P_OF}, 6)::double as p_value from y, a, e, w""")
def overview_cards(spark, sf):
    return r6(_analysis(spark, sf)["cards"])


@query()
def diagnostics(spark, sf):
    return _analysis(spark, sf)["diagnostics"]


@query("air_long", f"with {OWN} select strftime(day, '%Y-%m') as bucket, strftime(day, '%Y-%m') as key, round(avg(value), 3) as value, count(value) as count, '1-URGENT' as pollutant, 'aylık' as resolution, 'Bursa çoklu istasyon ortalaması' as station_selection, '1996-01-01' as start_date, '1998-12-31' as end_date from own group by all")
def export_series(spark, sf):
    return _analysis(spark, sf)["export"]


@query("geo", f"with {CTX}, v as (select cell_id, sum(value / power(m, 2)) / sum(1 / power(m, 2)) as value from (select cell_id, value, greatest({V.haversine('g.lat', 'g.lng', 's.lat', 's.lng')}, 1.0) as m from g, geo s where s.scope = 0) group by cell_id)"
       " select g.cell_id, 'PM10' as pollutant, 'idw' as method, round(lat, 6) as lat, round(lng, 6) as lng, round(value, 4) as value, road_density, green_ratio, impervious_ratio, round(nearest_road_m, 4) as nearest_road_m, round(nearest_industry_m, 4) as nearest_industry_m, proximity_index, industry_count as industry_count_3km from g join v on g.cell_id = v.cell_id join ctx on g.cell_id = ctx.cell_id")  # fmt: skip
def export_surface(spark, sf):
    cells = X.grid(spark, *GRID)
    values = X.idw(cells, V.geo(spark, sf).where("scope = 0")).select("cell_id", "value")
    out = R.surface_rows(cells, _contexts(spark, sf), values, pollutant="PM10", method="idw")
    return out.withColumns({"lat": S.rounded("lat"), "lng": S.rounded("lng")})


@query()
def export_forecast(spark, sf):
    filled = C._filled(spark, sf)
    return R.forecast_rows(P.forecasts(filled, ["pollutant"], 7), P.backtest(filled, ["pollutant"], 7), ["pollutant"], 7)


@query("monthly", "with s as (select pollutant, case when month(month) = 12 then year(month) + 1 else year(month) end as year, (month(month) % 12) // 3 as season, round(avg(value), 6) as value from monthly group by all) select * from s qualify row_number() over (partition by pollutant order by year desc, season desc) <= 12")
def compare_seasons(spark, sf):
    s = V.monthly(spark, sf).groupBy("pollutant", S.season_year("month").alias("year"), S.season_index("month").alias("season")).agg(F.avg("value").alias("value"))
    return r6(T.latest(s.withColumn("o", F.struct("year", "season")), ["pollutant"], "o", 12).drop("o"))


# the explorer --------------------------------------------------------------------------------------------------------
ASKED = R.Filters("1-URGENT", start="1996-01-15", end="1998-12-10")
NETWORK = "net as (select n_nationkey as id, n_name as name, case when n_nationkey % 5 = 4 then 'municipal' else 'official' end as source from nation)"
AROUND = """ctx as (select c_nationkey as station, 500 as radius, round(avg(c_acctbal) / 10000, 6) as building_density, round(count(*) / 100.0::double, 6) as road_density, round(count(*) filter (c_mktsegment = 'BUILDING') / count(*)::double, 6) as green_ratio,
  round(count(*) filter (c_acctbal < 0) / count(*)::double, 6) as impervious_ratio, count(*) filter (c_acctbal > 9000)::double as industry_count, round(max(c_acctbal), 6) as mean_elevation, round(min(c_acctbal), 6) as slope_mean from customer group by 1)"""


def _dataset(spark, sf):
    """Orders as measurements of nations' stations, customers as their surroundings."""
    source = F.when(F.col("n_nationkey") % 5 == 4, "municipal").otherwise("official")
    pollutants = V.air_long(spark, sf).groupBy(F.col("station").alias("id")).agg(F.collect_set("pollutant").alias("pollutants"))
    stations = V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), source.alias("source")).join(pollutants, "id")
    c, share = V.table(spark, sf, "customer"), lambda x: S.rounded(F.count_if(x) / F.count(F.lit(1)))
    contexts = c.groupBy(F.col("c_nationkey").alias("station")).agg(F.lit(500).alias("radius"), S.rounded(F.avg("c_acctbal") / 10000).alias("building_density"), S.rounded(F.count(F.lit(1)) / 100.0).alias("road_density"), share(F.col("c_mktsegment") == "BUILDING").alias("green_ratio"), share(F.col("c_acctbal") < 0).alias("impervious_ratio"), F.count_if(F.col("c_acctbal") > 9000).cast("double").alias("industry_count"), S.rounded(F.max("c_acctbal")).alias("mean_elevation"), S.rounded(F.min("c_acctbal")).alias("slope_mean"))
    records = V.air_long(spark, sf).withColumns({"ts": F.col("day").cast("timestamp"), "source": F.when(F.col("station") % 5 == 4, "municipal").otherwise("official")})
    return {"records": records, "stations": stations, "contexts": contexts}


@query("air_long", f"""with {NETWORK}, h as (select * from air_long where pollutant = '1-URGENT'), o as (select * from h where day between date '1996-01-15' and date '1998-12-10'),
r as (select station, avg(value) filter (k <= 16) as current, avg(value) as mean from (select *, row_number() over (partition by station order by day desc, value desc) as k from o) group by station),
hm as (select station, date_trunc('month', day) as m, avg(value) as v from h group by all), u as (select station, month(m) as k, avg(v) as usual, stddev_samp(v) as sd from hm group by all),
om as (select station, max(m) as m, arg_max(v, m) as v from (select station, date_trunc('month', day) as m, avg(value) as v from o group by all) group by station),
z as (select om.station, coalesce((v - usual) / nullif(sd, 0), 0) as z from om join u on om.station = u.station and month(om.m) = u.k)
select id as station, name, source, round(coalesce(current, 0), 6) as current, round(coalesce(z, 0), 6) as anomaly, round(coalesce(mean, 0), 6) as mean from net left join r on r.station = id left join z on z.station = id where id in (select station from h)""")
def station_snapshots(spark, sf):
    d = _dataset(spark, sf)
    return r6(W.snapshots(d["records"], d["stations"], ASKED))


@query("air_long", f"""with {AROUND}, m as (select station, avg(value) as mean from air_long where pollutant = '1-URGENT' and day between date '1996-01-15' and date '1998-12-10' group by station having avg(value) > 0),
x as (select metric, v, mean from (unpivot ctx on building_density, road_density, green_ratio, impervious_ratio, industry_count, mean_elevation, slope_mean into name metric value v) join m using (station))
select metric, round(coalesce(covar_pop(v, mean) / nullif(sqrt(var_pop(v) * var_pop(mean)), 0), 0), 6) as r, count(*) as n from x group by metric""")
def explorer_correlations(spark, sf):
    d = _dataset(spark, sf)
    return r6(W.correlations(d["records"], d["stations"], d["contexts"], ASKED, 500).select("metric", "r", "n"))


@query("air_long", f"""with {NETWORK}, r as (select station, avg(value) filter (k <= 16) as current from (select *, row_number() over (partition by station order by day desc, value desc) as k from air_long where pollutant = '1-URGENT' and day between date '1996-01-15' and date '1998-12-10') group by station)
select id as station, name, round(coalesce(current, 0), 6) as current from net left join r on r.station = id where id in (select station from air_long where pollutant = '1-URGENT') order by current desc, id limit 10 offset 10""")
def explorer_page(spark, sf):
    """The second page of the explorer's table of stations."""
    d = _dataset(spark, sf)
    found = W.snapshots(d["records"], d["stations"], ASKED)
    return r6(W.page((found, [F.col("current").desc(), F.col("station")]), 2, W.PAGES["stations"]).select("station", "name", "current"))
