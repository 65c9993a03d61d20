"""Station data as views of the driver's tables, in Spark and, word for word, in the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions import scalars as S

# fixed values: what kind of event each type of the table `events` stands for, and its number
KINDS = {"view": "fire", "click": "fire", "error": "dust", "purchase": "traffic", "signup": "fire"}
#: Years by which events of odd users are put back, into the time of orders and line items.
BACK = 27
#: Stations of the daily measurements of `ship`, and how many of them are physical ones.
STATIONS, PHYSICAL = 12, 10


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def air(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select((F.col("user_id") % 20).alias("station"), F.col("event_type").alias("pollutant"), "ts", F.to_date("ts").alias("day"), "value", "event_id")


def daily(spark, sf) -> DataFrame:
    return air(spark, sf).groupBy("station", "pollutant", "day").agg(S.rounded(F.avg("value")).alias("value"))


def air_long(spark, sf) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("station"), F.col("o_orderpriority").alias("pollutant"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("value"))


def monthly(spark, sf) -> DataFrame:
    m = F.trunc("day", "month")
    return air_long(spark, sf).groupBy("pollutant", m.alias("month")).agg(S.rounded(F.avg("value")).alias("value"))


def network_daily(spark, sf) -> DataFrame:
    """Days on which two stations or more report, averaged over station means."""
    per = air_long(spark, sf).groupBy("pollutant", "station", "day").agg(F.avg("value").alias("v"))
    return per.groupBy("pollutant", "day").agg(S.rounded(F.avg("v")).alias("value"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")


def meteo(spark, sf) -> DataFrame:
    days = air(spark, sf).select("station", "day").distinct()
    d = F.dayofmonth("day")
    return days.select("station", "day", ((F.col("station") * 37 + d * 13) % 360).cast("double").alias("wind_dir"), (1 + (F.col("station") % 5) * 0.5).cast("double").alias("wind_speed"), (10 + d % 7).cast("double").alias("temperature"), F.when(d % 4 != 0, (1000 + d).cast("double")).alias("pressure"), (d % 3 * 0.2).cast("double").alias("precipitation"))


def geo(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier")
    v = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(S.rounded(F.avg("l_extendedprice")).alias("value"))
    k = F.col("s_suppkey")
    out = s.join(v, s.s_suppkey == v.l_suppkey)
    return out.select(k.alias("id"), (k % 4).alias("scope"), (39.60 + (k * 7919 % 1000) / 1000.0 * 1.15).alias("lat"), (28.09 + (k * 104729 % 1000) / 1000.0 * 1.80).alias("lng"), "value")


def evt(spark, sf) -> DataFrame:
    """An event for each type and half of the users: from the day of its highest value on, for up to four days."""
    half = (F.col("user_id") % 2).alias("half")
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    number = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, 2 * i + 1)])
    n, peak = F.count(F.lit(1)), F.to_date(F.max(F.struct("value", "ts"))["ts"])
    own = table(spark, sf, "events").groupBy("event_type", half).agg(n.alias("n"), peak.alias("peak"), F.sum("event_id").alias("e"), F.sum("user_id").alias("u"))
    start = F.when(F.col("half") == 1, F.add_months("peak", -12 * BACK)).otherwise(F.col("peak"))
    return own.select((number[F.col("event_type")] + F.col("half")).cast("long").alias("event_id"), kinds[F.col("event_type")].alias("kind"), start.alias("start_day"), F.date_add(start, (F.col("n") % 4).cast("int")).alias("end_day"), (39.7 + F.col("e") % 1000 / 1000.0).alias("lat"), (28.2 + F.col("u") % 1500 / 1000.0).alias("lng"), (5.0 + F.col("n") % 25).alias("radius_km"))


def ship(spark, sf) -> DataFrame:
    """Daily means of stations that measure nearly every day for years: (station, pollutant, day, value)."""
    i = table(spark, sf, "lineitem")
    p = F.when(F.col("l_linenumber") <= 5, "PM10").otherwise("NO2")
    return i.groupBy((F.col("l_suppkey") % STATIONS).alias("station"), p.alias("pollutant"), F.to_date("l_shipdate").alias("day")).agg(S.rounded(F.avg("l_extendedprice") / 1000).alias("value"))


def ship_at(spark, sf) -> DataFrame:
    """(id, lat, lng, scope) of those stations, physical ones in both scopes."""
    first = lambda c: F.min_by(c, "id").alias(c)
    own = geo(spark, sf).groupBy((F.col("id") % STATIONS).alias("station")).agg(first("lat"), first("lng"))
    scopes = F.when(F.col("station") < PHYSICAL, F.array(F.lit("physical"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    return own.select(F.col("station").alias("id"), "lat", "lng", F.explode(scopes).alias("scope"))


SQL = {
    "air": "select user_id % 20 as station, event_type as pollutant, ts, ts::date as day, value, event_id from events",
    "daily": "select station, pollutant, day, round(avg(value), 6) as value from air group by all",
    "air_long": "select c_nationkey as station, o_orderpriority as pollutant, o_orderdate::date as day, o_totalprice as value from orders join customer on o_custkey = c_custkey",
    "monthly": "select pollutant, date_trunc('month', day)::date as month, round(avg(value), 6) as value from air_long group by all",
    "network_daily": "select pollutant, day, round(avg(v), 6) as value from (select pollutant, station, day, avg(value) as v from air_long group by all) group by pollutant, day having count(*) >= 2",
    "meteo": "select station, day, ((station * 37 + dayofmonth(day) * 13) % 360)::double as wind_dir, (1 + (station % 5) * 0.5)::double as wind_speed, (10 + dayofmonth(day) % 7)::double as temperature, case when dayofmonth(day) % 4 <> 0 then (1000 + dayofmonth(day))::double end as pressure, (dayofmonth(day) % 3 * 0.2)::double as precipitation from (select distinct station, day from air)",
    "geo": "select s_suppkey as id, s_suppkey % 4 as scope, 39.60::double + (s_suppkey * 7919 % 1000) / 1000.0::double * 1.15::double as lat, 28.09::double + (s_suppkey * 104729 % 1000) / 1000.0::double * 1.80::double as lng, value from supplier join (select l_suppkey, round(avg(l_extendedprice), 6) as value from lineitem group by l_suppkey) on s_suppkey = l_suppkey",
    "evt": f"""select list_position({list(KINDS)}, event_type) * 2 - 1 + half as event_id, {list(KINDS.values())}[list_position({list(KINDS)}, event_type)] as kind, start_day, start_day + (n % 4)::int as end_day,
  39.7::double + e % 1000 / 1000.0::double as lat, 28.2::double + u % 1500 / 1000.0::double as lng, 5.0::double + n % 25 as radius_km
  from (select *, case when half = 1 then (peak - interval {BACK} years)::date else peak end as start_day from
    (select event_type, user_id % 2 as half, count(*) as n, max({{'v': value, 't': ts}}).t::date as peak, sum(event_id)::bigint as e, sum(user_id)::bigint as u from events group by all))""",
    "ship": f"select l_suppkey % {STATIONS} as station, case when l_linenumber <= 5 then 'PM10' else 'NO2' end as pollutant, l_shipdate::date as day, round(avg(l_extendedprice) / 1000, 6) as value from lineitem group by all",
    "ship_at": f"select id, lat, lng, unnest(case when id < {PHYSICAL} then ['physical', 'all'] else ['all'] end) as scope from (select id % {STATIONS} as id, arg_min(lat, id) as lat, arg_min(lng, id) as lng from geo group by id % {STATIONS})",
}
NEEDS = {"daily": ["air"], "monthly": ["air_long"], "network_daily": ["air_long"], "meteo": ["air"], "ship_at": ["geo"]}
MACRO_HAVERSINE = "2 * 6371000.0 * asin(least(1.0, sqrt(power(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin((radians({d}) - radians({b})) / 2), 2))))"


def with_views(names: str, body: str) -> str:
    """A query over views: WITH the named ones and what they need."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    views = ",\n".join(f"{n} as ({SQL[n]})" for n in order)
    body = body.strip()
    return f"with {views},\n{body[5:]}" if body.startswith("with ") else f"with {views}\n{body}"


def haversine(a: str, b: str, c: str, d: str) -> str:
    return MACRO_HAVERSINE.format(a=a, b=b, c=c, d=d)


def overlap_sql(s1: str, e1: str, s2: str, e2: str) -> str:
    """Days that two spans share, the second of fixed ends."""
    return f"greatest(least({e1}, date '{e2}') - greatest({s1}, date '{s2}') + 1, 0)"


def nudged(sql: str) -> str:
    """The same nudge before rounding to 6 digits as S.rounded has."""
    return sql.replace(", 6)", " + 1e-9, 6)")
