"""A dataset as its explorer shows it: station snapshots, correlations, rose, and named views that can be paged through."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions import scalars as S
from windrow.operators import events as E
from windrow.operators import results as R
from windrow.operators import temporal as T

#: Records that a station's present value is the mean of.
RECENT = 16
# fixed values: metrics of surroundings and what they are called; rows of a page of each view
METRICS = {
    "building_density": "Bina yoğunluğu",
    "road_density": "Yol yoğunluğu",
    "green_ratio": "Yeşil oranı",
    "impervious_ratio": "Geçirimsiz yüzey",
    "industry_count": "Sanayi sayısı",
    "mean_elevation": "Ortalama yükseklik",
    "slope_mean": "Ortalama eğim",
}
PAGES = {"series": 12, "comparison": 12, "stations": 10, "meteo": 14, "contexts": 8, "events": 8, "neighborhoods": 10}


def available(stations: DataFrame, f: R.Filters) -> DataFrame:
    """Stations (id, name, source, pollutants) of the scope that measure the pollutant."""
    own = F.array_contains("pollutants", f.pollutant)
    return stations.where(own if f.scope == "all" else own & (F.coalesce("source", F.lit(R.OFFICIAL)) == f.scope))


def snapshots(records: DataFrame, stations: DataFrame, f: R.Filters) -> DataFrame:
    """(station, name, source, current, anomaly, mean) of every available station: the mean of its last RECENT records in the range,
    the last month's z against the same months of its whole history, the mean of the range; 0 where there is nothing."""
    every = replace(f.normalised(), station="all")
    at = F.struct("ts", "value")
    own, whole = records.where(every.predicate()), records.where(every.predicate(dated=False))
    recent = T.latest(own.withColumn("_at", at), ["station"], "_at", RECENT).groupBy("station").agg(F.avg("value").alias("current"))
    month = F.trunc("day", "month")
    monthly = lambda df: df.groupBy("station", month.alias("month")).agg(F.avg("value").alias("value"))
    sd = F.coalesce(F.stddev_samp("value"), F.lit(0.0))
    usual = monthly(whole).groupBy("station", F.month("month").alias("m")).agg(F.avg("value").alias("usual"), sd.alias("sd"))
    last = monthly(own).groupBy("station").agg(F.max_by("value", "month").alias("value"), F.month(F.max("month")).alias("m"))
    z = F.coalesce((F.col("value") - F.col("usual")) / F.nullif("sd", F.lit(0.0)), F.lit(0.0))
    anomaly = last.join(usual, ["station", "m"]).select("station", z.alias("anomaly"))
    means = own.groupBy("station").agg(F.avg("value").alias("mean"))
    out = available(stations, f).select(F.col("id").alias("station"), "name", "source")
    for part in (recent, anomaly, means):
        out = out.join(part, "station", "left")
    return out.fillna(0.0, ["current", "anomaly", "mean"])


def correlations(records: DataFrame, stations: DataFrame, contexts: DataFrame, f: R.Filters, radius: int) -> DataFrame:
    """(metric, label, r, n): how each metric of the stations' surroundings (station, radius, METRICS) within a radius goes with the
    stations' means, of those whose mean is over 0."""
    every = replace(f.normalised(), station="all")
    means = records.where(every.predicate()).groupBy("station").agg(F.avg("value").alias("mean")).where("mean > 0")
    means = means.join(available(stations, f).select(F.col("id").alias("station")), "station", "left_semi")
    rows = contexts.where(F.col("radius") == radius).join(means, "station").select("station", "mean", *[F.col(c).cast("double").alias(c) for c in METRICS])
    long = rows.unpivot(["station", "mean"], list(METRICS), "metric", "v")
    labels = F.create_map(*[F.lit(x) for pair in METRICS.items() for x in pair])
    found = T.pearson(long, ["metric"], "v", "mean")
    names = long.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, METRICS))).alias("metric"))
    return names.join(found, "metric", "left").select("metric", labels[F.col("metric")].alias("label"), F.coalesce("r", F.lit(0.0)).alias("r"), F.coalesce("n", F.lit(0)).alias("n"))


def rose(records: DataFrame, meteo: DataFrame, f: R.Filters) -> DataFrame:
    """(direction, value, wind) of all eight directions: means of the records of the range under wind from there; 0 without any."""
    own = records.where(f.normalised().predicate()).join(meteo.select("station", "day", "wind_dir", "wind_speed"), ["station", "day"])
    bins = own.where("wind_dir is not null").groupBy(S.compass("wind_dir").alias("direction")).agg(F.avg("value").alias("value"), F.avg("wind_speed").alias("wind"))
    every = records.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, S.COMPASS))).alias("i", "direction"))
    return every.join(bins, "direction", "left").orderBy("i").select("direction", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("value", "wind")])


def analyze_dataset(tables: dict[str, DataFrame], f: R.Filters, threshold: float, radius: int = 500) -> dict[str, DataFrame]:
    """`results.analyze` of a dataset's records with all that needs its other tables: snapshots, correlations, rose, the event asked
    for and its impact on the available stations. tables: records (station, pollutant, ts, day, value, source), stations (id, name,
    source, pollutants, lat, lng), meteo (station, day, ..), contexts (station, radius, METRICS) and events."""
    records, stations = tables["records"], tables["stations"]
    own = available(stations, f)
    inside = records.join(own.select(F.col("id").alias("station")), "station", "left_semi")
    event = R.picked_event(tables["events"], f)
    daily = inside.where(replace(f, station="all").predicate(dated=False)).groupBy("station", "day").agg(F.avg("value").alias("value"))
    return R.analyze(inside, f, threshold) | {
        "snapshots": snapshots(inside, stations, f),
        "selected_contexts": selected(tables["contexts"].where(F.col("radius") == radius), "station", own, f),
        "correlations": correlations(inside, stations, tables["contexts"], f, radius),
        "rose": rose(inside, tables["meteo"], f),
        "event": event,
        "event_impact": E.impact(event, own.select("id", "lat", "lng"), daily, tables["meteo"]),
    }


def selected(rows: DataFrame, station: str, stations: DataFrame, f: R.Filters) -> DataFrame:
    """Rows of the selected stations: the one that is asked for, or all available ones."""
    own = stations.select(F.col("id").alias(station)) if f.station == "all" else stations.where(F.col("id").cast("string") == f.station).select(F.col("id").alias(station))
    return rows.join(own, station, "left_semi")


def meteo_days(meteo: DataFrame, stations: DataFrame, f: R.Filters) -> DataFrame:
    """A row per day of the range over the selected stations: means, the wind's mean direction, the precipitation's sum."""
    f = f.normalised()
    own = selected(meteo, "station", available(stations, f), f)
    if f.start:
        own = own.where(F.col("day") >= F.lit(f.start).cast("date"))
    if f.end:
        own = own.where(F.col("day") <= F.lit(f.end).cast("date"))
    means = [F.avg(c).alias(c) for c in ("temperature", "humidity", "wind_speed", "pressure") if c in meteo.columns]
    return own.groupBy("day").agg(*means, T.circular_mean("wind_dir").alias("wind_dir"), F.sum("precipitation").alias("precipitation"))


COMPARISONS = ("month-over-month", "season-over-season", "same-month")


def comparison(records: DataFrame, f: R.Filters, mode: str = COMPARISONS[0]) -> DataFrame:
    """The last 18 months, the last 12 seasons, or the last month's calendar month in every year."""
    own, keys = records.where(f.normalised().predicate()), ["pollutant"]
    if mode == "season-over-season":
        return T.latest(T.bucket_mean(own, keys, "season"), keys, "first_day", 12)
    monthly = T.bucket_mean(own, keys, "month").withColumn("month", F.trunc("first_day", "month"))
    return (T.latest(monthly, keys, "month", 18) if mode == "month-over-month" else T.same_month(monthly, keys)).drop("month")


def views(tables: dict[str, DataFrame], analysis: dict[str, DataFrame], f: R.Filters, mode: str = COMPARISONS[0]) -> dict[str, tuple[DataFrame, list[Column]]]:
    """The explorer's tables by name, each with its order: series, comparison, stations, meteo, contexts, events, neighborhoods."""
    g = f.normalised()
    stations = tables["stations"].select(F.col("id").alias("station"), F.col("name").alias("station_name"))
    named = analysis["selected_contexts"].join(stations, "station", "left").withColumn("station_name", F.coalesce("station_name", F.col("station").cast("string")))
    out = {
        "series": (analysis["series"], [F.col("bucket")]),
        "comparison": (comparison(tables["records"], f, mode), [F.col("bucket")]),
        "stations": (analysis["snapshots"], [F.col("current").desc(), F.col("station")]),
        "meteo": (meteo_days(tables["meteo"], tables["stations"], f), [F.col("day").desc()]),
        "contexts": (named, [F.col("station")]),
        "events": (E.overlapping(tables["events"], g.start or "0001-01-01", g.end or "9999-12-31"), [F.col("start_day").desc(), F.col("event_id")]),
    }
    if "neighborhoods" in tables:
        out["neighborhoods"] = (tables["neighborhoods"], [F.size("stations").desc(), F.coalesce("road_density", F.lit(0.0)).desc(), F.col("area")])
    return out


def page(view: tuple[DataFrame, list[Column]], number: int, size: int) -> DataFrame:
    """The rows of one page, from 1, in the view's order."""
    rows, order = view
    ranked = rows.orderBy(*order)
    return (ranked.offset((number - 1) * size) if number > 1 else ranked).limit(size)
