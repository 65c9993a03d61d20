"""What a user asks for and gets: filters, the temporal analysis as a set of tables, merged slices, rows for export."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions import labels as L
from windrow.functions import scalars as S
from windrow.operators import events as E
from windrow.operators import temporal as T

OFFICIAL = "official"


@dataclass(frozen=True)
class Filters:
    """pollutant and scope (all, official, municipal-official, sensor source names); station; an inclusive range of
    days, open where empty; resolution; an event."""

    pollutant: str
    scope: str = "all"
    station: str = "all"
    start: str = ""
    end: str = ""
    resolution: str = "month"
    event_id: int | None = None

    def normalised(self, stations: set[str] | None = None) -> Filters:
        """The range the right way round, and no station that the scope and pollutant don't have."""
        out = replace(self, start=self.end, end=self.start) if self.start and self.end and self.start > self.end else self
        return replace(out, station="all") if stations is not None and out.station not in stations else out

    def for_event(self, event_id: int, start: str, end: str) -> Filters:
        """An event by day: from a week before it to two weeks after."""
        from datetime import date, timedelta

        return replace(self, event_id=event_id, resolution="day", start=str(date.fromisoformat(start) - timedelta(7)), end=str(date.fromisoformat(end) + timedelta(14)))

    def predicate(self, day: str = "day", dated: bool = True) -> Column:
        out = F.col("pollutant") == self.pollutant
        if self.scope != "all":
            out &= F.coalesce("source", F.lit(OFFICIAL)) == self.scope
        if self.station != "all":
            out &= F.col("station").cast("string") == self.station
        if dated and self.start:
            out &= F.col(day) >= F.lit(self.start).cast("date")
        if dated and self.end:
            out &= F.col(day) <= F.lit(self.end).cast("date")
        return out


def picked_event(events: DataFrame, filters: Filters) -> DataFrame:
    """The event asked for; else the first that overlaps the range; else the first of all if no range is given."""
    if filters.event_id is not None:
        return events.where(F.col("event_id") == filters.event_id)
    lo, hi = filters.start or "0001-01-01", filters.end or "9999-12-31"
    return E.overlapping(events, lo, hi).orderBy("event_id").limit(1)


def analyze(records: DataFrame, filters: Filters, threshold: float) -> dict[str, DataFrame]:
    """The temporal analysis of records (station, pollutant, day, value, source) as lazy tables by name."""
    f = filters.normalised()
    own, history = records.where(f.predicate()), records.where(f.predicate(dated=False))
    keys, month = ["pollutant"], F.trunc("day", "month")
    monthly = own.groupBy(*keys, month.alias("month")).agg(F.avg("value").alias("value"))
    whole = history.groupBy(*keys, month.alias("month")).agg(F.avg("value").alias("value"))
    daily = own.groupBy(*keys, "day").agg(F.avg("value").alias("value"))
    series = T.bucket_mean(own, keys, f.resolution)
    out = {
        "series": series,
        "latest": T.latest(monthly, keys, "month", 18),
        "same_month": T.same_month(monthly, keys),
        "trend": T.mann_kendall(monthly, keys, "month"),
        "seasonal_trend": T.seasonal_kendall(monthly, keys),
        "change_point": T.change_point(monthly, keys),
        "episodes": T.episodes(daily, keys, threshold),
        "decomposition": T.kz_decomposition(monthly, keys, "month"),
        "weekdays": T.weekday_weekend(own, keys),
        "anomalies": T.monthly_zscore(whole, keys).join(monthly.select(*keys, "month"), [*keys, "month"], "left_semi"),
    }
    return out | {"cards": cards(series, out, keys), "diagnostics": diagnostics(out, keys), "export": series_rows(series, f, records)}


def cards(series: DataFrame, found: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One row per series: mean, mean anomaly, days over the threshold, weekdays less weekends, trend."""
    out = series.groupBy(*keys).agg(F.avg("mean").alias("mean"))
    parts = (
        found["anomalies"].groupBy(*keys).agg(F.avg("z").alias("anomaly")),
        found["episodes"].select(*keys, "exceedance_days"),
        found["weekdays"].select(*keys, F.col("difference").alias("weekday_difference")),
        found["trend"].select(*keys, "slope", "tau", "p_value"),
    )
    for part in parts:
        out = out.join(part, keys, "left")
    return out


def diagnostics(found: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Four cards for each series: id, value and tone."""
    seasonal, change, runs, kz = (found[k] for k in ("seasonal_trend", "change_point", "episodes", "decomposition"))
    card = lambda df, name, value, tone: df.select(*keys, F.lit(name).alias("id"), value.alias("value"), tone.alias("tone"))
    rising = lambda c, up, down: F.when(F.col(c) == up, "warning").when(F.col(c) == down, "cool").otherwise("neutral")
    out = card(seasonal, "seasonal-kendall", F.when(F.col("direction") == "stable", "Yatay eğilim").otherwise(F.concat(L.signed("slope_per_year", 2), F.lit(" µg/m3/yıl"))), rising("direction", "increasing", "decreasing"))
    out = out.unionByName(card(change, "cusum-break", F.date_format("break_at", "yyyy-MM"), rising("direction", "upward", "downward")))
    out = out.unionByName(card(runs, "exceedance-episodes", F.concat(F.col("episode_count").cast("string"), F.lit(" epizot")), F.when(F.col("longest") >= 3, "warning").otherwise("accent")))
    share = F.concat(F.lit("%"), F.floor(F.col("background_share") * 100 + 0.5).cast("string"), F.lit(" arka plan"))
    return out.unionByName(card(kz, "kz-decomposition", share, F.when(F.col("residual_share") >= 0.45, "accent").otherwise("cool")))


# slices --------------------------------------------------------------------------------------------------------------
def month_slices(records: DataFrame, keys: list[str]) -> DataFrame:
    """(slice_id, kind, start_day, end_day, keys, value, days): each month's mean by key; whole months."""
    m = F.trunc("day", "month")
    out = records.groupBy(*keys, m.alias("start_day")).agg(F.avg("value").alias("value"), F.countDistinct("day").alias("days"))
    return out.select(F.concat(F.lit("month-"), F.date_format("start_day", "yyyy-MM")).alias("slice_id"), F.lit("month").alias("kind"), "start_day", F.last_day("start_day").alias("end_day"), *keys, "value", "days")


def event_slices(records: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """The same for each event's days, where it has any."""
    e = events.select(F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("slice_id"), "start_day", "end_day")
    joined = records.join(e.withColumn("day", F.explode(F.sequence("start_day", "end_day"))), "day")  # an equal join, whatever events overlap
    out = joined.groupBy("slice_id", "start_day", "end_day", *keys).agg(F.avg("value").alias("value"), F.countDistinct("day").alias("days"))
    return out.select("slice_id", F.lit("event").alias("kind"), "start_day", "end_day", *keys, "value", "days")


def merged_stats(slices: DataFrame, keys: list[str], start: str | Column, end: str | Column) -> DataFrame:
    """z and p weighted by days; the class is read off again."""
    out = E.day_weighted(slices, keys, ["z", "p_value"], start, end).withColumn("z", S.rounded("z"))
    return out.withColumn("class", S.hotspot_class("z"))


def merged_risk(slices: DataFrame, keys: list[str], components: list[str], start: str | Column, end: str | Column) -> DataFrame:
    """Score and components weighted by days; the label is read off the merged score."""
    out = E.day_weighted(slices, keys, ["score", *components], start, end).withColumn("score", S.rounded("score"))
    return out.withColumn("label", S.risk_label("score"))


def merged_drivers(slices: DataFrame, keys: list[str], start: str | Column, end: str | Column) -> DataFrame:
    """Coefficients weighted by days, samples added up, and the prevailing wind as a weighted mean direction."""
    w = S.overlap_days("start_day", "end_day", *[(x if isinstance(x, Column) else F.lit(x)).cast("date") for x in (start, end)])
    own, a = slices.withColumn("w", w).where("w > 0"), F.radians("wind")
    wind = F.pmod(F.degrees(F.atan2(F.sum(F.sin(a) * F.col("w")), F.sum(F.cos(a) * F.col("w")))), F.lit(360.0))
    return own.groupBy(*keys).agg((F.sum(F.col("coefficient") * F.col("w")) / F.sum("w")).alias("coefficient"), F.sum("n").cast("long").alias("n"), wind.alias("wind"))


# rows for export -----------------------------------------------------------------------------------------------------
# fixed values: what resolutions and a choice of all stations are called
RESOLUTIONS = {"day": "günlük", "month": "aylık", "season": "mevsimlik", "year": "yıllık"}
ALL_STATIONS = "Bursa çoklu istasyon ortalaması"


def series_rows(series: DataFrame, f: Filters, records: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """A row for each bucket, with what was asked for in words: the resolution, the station's name (id, name) or that all count, and
    the range's days, open ones those of the records."""
    days = {"start_date": F.lit(f.start or None).cast("string"), "end_date": F.lit(f.end or None).cast("string")}
    rows = series
    if records is not None and not (f.start and f.end):
        ends = records.agg(F.min("day").cast("string").alias("_first"), F.max("day").cast("string").alias("_last")).withColumn("_one", F.lit(1))
        rows = series.withColumn("_one", F.lit(1)).join(ends, "_one", "left")
        days = {"start_date": F.coalesce(days["start_date"], F.col("_first")), "end_date": F.coalesce(days["end_date"], F.col("_last"))}
    name = F.lit(ALL_STATIONS if f.station == "all" else f.station)
    if f.station != "all" and names is not None:
        own = names.where(F.col("id").cast("string") == f.station).agg(F.first("name").alias("_name")).withColumn("_two", F.lit(1))
        rows = rows.withColumn("_two", F.lit(1)).join(own, "_two", "left")
        name = F.coalesce("_name", name)
    return rows.select(F.col("label").alias("bucket"), F.col("bucket").alias("key"), F.round("mean", 3).alias("value"), F.col("n").alias("count"), "pollutant", F.lit(RESOLUTIONS.get(f.resolution, f.resolution)).alias("resolution"), name.alias("station_selection"), *[v.alias(k) for k, v in days.items()])


def numbers(*columns: str) -> list[Column]:
    """Values for export: 4 digits, no NaN."""
    return [F.when(~F.isnan(c), F.round(c, 4)).alias(c) for c in columns]


def surface_rows(cells: DataFrame, contexts: DataFrame, values: DataFrame, **fixed: str) -> DataFrame:
    """A row for each cell: where it is, its value, its context; cells without either keep nulls and zeros."""
    out = cells.select("cell_id", "lat", "lng").join(values, "cell_id", "left").join(contexts, "cell_id", "left").fillna(0.0, ["road_density", "green_ratio", "impervious_ratio", "proximity_index"])
    context = ["road_density", "green_ratio", "impervious_ratio", "nearest_road_m", "nearest_industry_m", "proximity_index"]
    return out.select("cell_id", *[F.lit(v).alias(k) for k, v in fixed.items()], F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), *numbers("value", *context), F.coalesce("industry_count", F.lit(0)).cast("long").alias("industry_count_3km"))


def forecast_rows(points: DataFrame, accuracy: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    band = 1.64 * F.col("rmse")
    out = points.join(accuracy.select(*keys, "mae", "rmse"), keys).withColumns({"lower": F.col("value") - band, "upper": F.col("value") + band})
    return out.select(*keys, F.lit(horizon).cast("long").alias("horizon_days"), "day", *numbers("value", "lower", "upper", "mae", "rmse"))


def unique_slugs(titles: DataFrame, title: str, order: str) -> DataFrame:
    """titles with an id: the slug, and -2, -3 and so on where it was taken by a row before."""
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("slug").orderBy(order))
    numbered = titles.withColumn("slug", S.slug(title)).withColumn("i", i)
    return numbered.withColumn("slug", F.when(F.col("i") > 1, F.concat_ws("-", "slug", F.col("i").cast("string"))).otherwise(F.col("slug"))).drop("i")


def referenced(catalogues: list[DataFrame], title: str, place: str = "place") -> DataFrame:
    """Rows of several catalogues with ids as `unique_slugs` gives them, in the order of the catalogues and, in each, of its places."""
    rows = None
    for rank, df in enumerate(catalogues):
        own = df.withColumn("_order", F.struct(F.lit(rank).alias("rank"), F.col(place).alias("place"))).drop(place)
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    return unique_slugs(rows, title, "_order").drop("_order")
