"""Slices of a period or an event: gates, statistics, their merging by scope, what is joined to them, and rows for export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions import scalars as S
from windrow.operators import events as E
from windrow.operators import forecast as P
from windrow.operators import layers as Y
from windrow.operators import results as R
from windrow.operators import spatial as X
from windrow.operators.results import numbers
from windrow.operators.tables import written

SCOPES = ("physical", "all")
MODELED = "Modellenmiş seçim için yüzey üretilmez."


# statistics ----------------------------------------------------------------------------------------------------------
def observations(daily: DataFrame, slices: DataFrame, stations: DataFrame, keys: list[str]) -> DataFrame:
    """(slice_id, keys, id, lat, lng, value, days, completeness) of each station in each slice (slice_id, start_day,
    end_day): its mean over the slice's days, and the share of these that it has."""
    day = F.explode(F.sequence("start_day", "end_day"))
    days = slices.select("slice_id", (F.datediff("end_day", "start_day") + 1).alias("length"), day.alias("day"))  # an equal join, whatever slices overlap
    per = daily.join(days, "day").groupBy("slice_id", *keys, "station", "length").agg(F.avg("value").alias("value"), F.countDistinct("day").alias("days"))
    at = stations.select(F.col("id").alias("station"), "lat", "lng")
    return per.join(at, "station").select("slice_id", *keys, F.col("station").alias("id"), "lat", "lng", "value", "days", F.least(F.lit(1.0), F.col("days") / F.col("length")).alias("completeness"))


def gates(obs: DataFrame, keys: list[str], least_stations: int = 6, least_completeness: float = 0.7) -> DataFrame:
    """(keys, station_count, observation_count, mean_completeness, status) of slices' observations."""
    per = obs.groupBy(*keys).agg(F.countDistinct("id").alias("station_count"), F.sum("days").alias("observation_count"), F.avg("completeness").alias("mean_completeness"))
    status = F.when(F.col("station_count") < least_stations, "insufficient-observations").when(F.col("mean_completeness") < least_completeness, "insufficient-completeness").otherwise("ok")
    return per.withColumn("status", status)


def stats(obs: DataFrame, keys: list[str], label: str) -> DataFrame:
    """gates of slices with radius, moran_i, z and p_value for those that pass; a slice that passes but whose values or
    places don't differ has insufficient observations after all."""
    gated = gates(obs, keys)
    ok = gated.where("status = 'ok'").select(*keys)
    found = X.moran_permutation(obs.join(ok, keys, "left_semi"), keys, label).drop("n")
    status = F.when((F.col("status") == "ok") & F.col("moran_i").isNull(), "insufficient-observations").otherwise(F.col("status"))
    return gated.join(found, keys, "left").withColumn("status", status)


def hotspots(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Gi* of the stations of slices that pass the gates."""
    ok = gates(obs, keys).where("status = 'ok'").select(*keys)
    return X.getis_ord(obs.join(ok, keys, "left_semi"), keys)


def exceedance(cells: DataFrame, daily: DataFrame, stations: DataFrame, keys: list[str], limit: float, least_stations: int = 4) -> DataFrame:
    """(keys, cell_id, value, exceedance) of the slices (keys) that have enough stations: the surfaces of the stations' means
    and of the share of their days over a limit."""
    per = daily.groupBy(*keys, "station").agg(F.avg("value").alias("value"), F.avg((F.col("value") > limit).cast("double")).alias("over"))
    at = per.join(stations.select(F.col("id").alias("station"), "lat", "lng"), "station")
    ok = at.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_stations).select(*keys)
    good = at.join(ok, keys, "left_semi")
    over = X.idw(cells, good.drop("value").withColumnRenamed("over", "value"), keys).withColumnRenamed("value", "exceedance")
    return X.idw(cells, good, keys).join(over, [*keys, "cell_id"])


# merging -------------------------------------------------------------------------------------------------------------
def upserted(old: DataFrame, new: DataFrame, payload: list[str], scopes: tuple[str, ...] = SCOPES) -> DataFrame:
    """A row for each slice, in order of its start: new slices (slice_id, kind, label, start_day, end_day, scope, payload)
    are added to old ones or take their place within their scope; what a slice is comes from where it was met first."""
    rows = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    about = ["kind", "label", "start_day", "end_day"]
    first = [F.min_by(c, "age").alias(c) for c in about]
    own = [F.max_by(F.when(F.col("scope") == s, F.col(c)), F.when(F.col("scope") == s, F.col("age"))).alias(f"{s}_{c}") for s in scopes for c in payload]
    return rows.groupBy("slice_id").agg(*first, *own).orderBy("start_day", "slice_id")


def with_stats(surfaces: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Surfaces with their statistics' status and number of hotspots; those without any count as insufficient."""
    out = surfaces.join(found.select(*keys, F.col("status").alias("stats_status"), "hotspots"), keys, "left")
    return out.fillna({"stats_status": "insufficient-observations", "hotspots": 0})


def risk_cells(cells: DataFrame, contexts: DataFrame, risks: DataFrame) -> DataFrame:
    """Cells that have a risk, with their context; without one its densities and counts are 0 and its distances null."""
    zero = {c: 0.0 for c in ("road_density", "green_ratio", "impervious_ratio", "proximity_index")} | {"industry_count": 0}
    return cells.join(risks, "cell_id").join(contexts, "cell_id", "left").fillna(zero)


def surface_values(slices: DataFrame, cells: DataFrame) -> DataFrame:
    """(slice_id, cell_id, value, load, exceedance) from slices' arrays, which are in order of the cells' numbers (i). The
    load is the value's share of the slice's greatest; values that are missing or no numbers are left out."""
    zipped = slices.select("slice_id", F.posexplode(F.arrays_zip("values", "exceedances")).alias("i", "v"))
    own = zipped.select("slice_id", "i", F.col("v.values").alias("value"), F.col("v.exceedances").alias("exceedance")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    most = F.max("value").over(Window.partitionBy("slice_id"))
    load = F.when(most > 0, F.col("value") / most).otherwise(0.0)
    return own.withColumn("load", load).join(cells.select("i", "cell_id"), "i").select("slice_id", "cell_id", "value", "load", F.coalesce("exceedance", F.lit(0.0)).alias("exceedance"))


def normalised(slices: DataFrame, payload: dict[str, str]) -> DataFrame:
    """Slices with what may lack filled in: supported and its reason from the status, counts and completeness as 0, numbers
    of the payload null where they are no numbers or the slice has no support."""
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    own = [F.when(ok & ~F.isnan(c), F.col(c)).cast(t).alias(c) for c, t in payload.items()]
    reason = F.when(~ok, F.coalesce("failure", F.lit("Yeterli sayida olculmus istasyon yok.")))
    return slices.select("slice_id", ok.alias("supported"), reason.alias("unavailable_reason"), F.coalesce("station_count", F.lit(0)).cast("long").alias("eligible_station_count"), F.coalesce("mean_completeness", F.lit(0.0)).alias("mean_completeness"), *own)


# selection -----------------------------------------------------------------------------------------------------------
def modeled_reason(source: Column | str) -> Column:
    """Why a selected station has no surface: modeled ones don't."""
    source = F.col(source) if isinstance(source, str) else source
    return F.when(source == "modeled", F.lit(MODELED))


def methods(slices: DataFrame) -> DataFrame:
    """The methods with at least one supported slice in each scope."""
    return slices.groupBy("scope", "method").agg(F.max("supported").alias("supported"), F.sum(F.col("supported").cast("long")).alias("slices")).where("supported").drop("supported")


def overlapping_slice(slices: DataFrame, start: str, end: str, wanted: str | int | None = None, months: bool = False, known: DataFrame | None = None) -> DataFrame:
    """The slices of a request: the wanted one, whatever its days, if it is among the known ones (these, unless others are
    given); else all that touch the range, with `months` those of kind month alone."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    touching = (F.col("end_day") >= first) & (F.col("start_day") <= last)
    if months:
        touching &= F.col("kind") == "month"
    if wanted is None:
        return slices.where(touching)
    return slices.where(F.when(there(slices if known is None else known, wanted), F.col("slice_id") == wanted).otherwise(touching))


def there(slices: DataFrame, wanted: str | int) -> Column:
    """Whether there is a slice of that id, as one value of a query of its own."""
    return slices.where(F.col("slice_id") == wanted).agg(F.count(F.lit(1)) > 0).scalar()


@dataclass(frozen=True)
class Request:
    """What is asked of a package: days, a scope, a method of surfaces, and a slice that goes before the days."""

    start: str
    end: str
    scope: str = "physical"
    method: str = "idw"
    slice_id: str | None = None
    version: str | None = None


def first_rows(rows: DataFrame, column: str, n: int, ascending: bool = False) -> DataFrame:
    """The n rows with the greatest (or least) values, ties by id; those without a value are left out."""
    return rows.where(F.col(column).isNotNull()).orderBy(F.col(column).asc() if ascending else F.col(column).desc(), rows.columns[0]).limit(n)


def refused(request: Request, versions: dict[str, str], modeled: bool = False) -> str | None:
    """Why a request has no result: a modeled station is selected, or manifest or package are of another version."""
    if modeled:
        return MODELED
    if request.version is not None and versions.get("manifest", request.version) != request.version:
        return "Analiz paketi veri surumu ile uyusmuyor."
    if request.version is not None and versions.get("package", request.version) != request.version:
        return "Kirletici paketi guncel veri seti ile uyusmuyor."
    return None


def resolved(package: dict[str, DataFrame], request: Request) -> dict[str, DataFrame]:
    """The tables that answer a request, from a package's tables: surfaces (slice_id, start_day, end_day, scope, method, cell_id,
    value, exceedance), stats (.., scope, station, z, p_value), risks (.., scope, cell_id, score, components), drivers
    (.., scope, driver, coefficient, n, wind), forecasts (scope, supported, ..), contexts and cells by cell_id.

    Surfaces are the asked slice's, whatever its days, or those of the months that touch the days; statistics, risks and
    drivers those of the same slice, or of all slices, events too, that touch the days. They are merged with weights by days. A method
    without any such slice gives way to inverse distances. Merged cells come with their context, the 6 highest and lowest
    and the 6 most often over the limit, the 8 nearest to sources; stations with the 8 hottest and coldest; risks with the 10
    highest; drivers by weight; forecasts that are supported. `answer` is one row about the result (see `answer`)."""
    surfaces = package["surfaces"].where(F.col("scope") == request.scope)
    found = there(surfaces, request.slice_id) if request.slice_id is not None else F.lit(False)

    def chosen(name: str) -> DataFrame:
        own = package[name].where(F.col("scope") == request.scope)
        return overlapping_slice(own, request.start, request.end, request.slice_id, months=name == "surfaces", known=surfaces)

    # a slice that was asked for counts with all its days
    start = F.when(found, F.lit("0001-01-01")).otherwise(F.lit(request.start)).cast("date")
    end = F.when(found, F.lit("9999-12-31")).otherwise(F.lit(request.end)).cast("date")
    own = chosen("surfaces")
    ranked = own.select("method").distinct().select("method", F.when(F.col("method") == request.method, 0).when(F.col("method") == "idw", 1).alias("r")).where("r is not null")
    method = ranked.orderBy("r").limit(1).select("method")
    rows = own.join(F.broadcast(method), "method", "left_semi")
    merged = E.day_weighted(rows, ["cell_id"], ["value", "exceedance"], start, end)
    cells = package["cells"].join(merged, "cell_id", "left").join(package["contexts"], "cell_id", "left")
    spots = R.merged_stats(chosen("stats"), ["station"], start, end)
    rows = chosen("risks")
    components = [c for c, t in rows.dtypes if t == "double" and c != "score"]
    risks = R.merged_risk(rows, ["cell_id"], components, start, end)
    drivers = R.merged_drivers(chosen("drivers"), ["driver"], start, end)
    used = own.join(F.broadcast(method), "method", "left_semi").select("slice_id", *[c for c in ("label",) if c in own.columns], "start_day", "end_day", "method").distinct()
    return {
        "answer": answer(used, request, found),
        "method": method,
        "cells": cells,
        "top_polluted": first_rows(cells, "value", 6),
        "cleanest": first_rows(cells, "value", 6, ascending=True),
        "highest_exceedance": first_rows(cells, "exceedance", 6),
        "highest_proximity": first_rows(cells, "proximity_index", 8),
        "stations": spots,
        "top_hotspots": first_rows(spots.where("z > 0"), "z", 8),
        "top_coldspots": first_rows(spots.where("z < 0"), "z", 8, ascending=True),
        "risks": risks,
        "top_risks": first_rows(risks, "score", 10),
        "drivers": drivers.orderBy(F.abs("coefficient").desc(), "driver"),
        "forecasts": package["forecasts"].where((F.col("scope") == request.scope) & F.col("supported")),
    }


# fixed values: what a request's answer says of itself
NO_SLICE = "Secili tarih araligi icin kullanilabilir mekansal dilim yok."
FALLBACK = "Secili dilimde Kriging uygun bulunmadi; IDW yuzeyi kullanildi."
MERGED = "mekansal birlesimi"


def answer(used: DataFrame, request: Request, found: Column) -> DataFrame:
    """One row about the slices (slice_id, start_day, end_day, method, maybe label) that a request's surface is merged of, where
    found says that it is the asked one: label, mode, start_day, end_day, days, slices_used, requested_method,
    effective_method, fallback, notice, unsupported_reason."""
    own = F.min("label") if "label" in used.columns else F.min("slice_id")
    day = lambda x: F.lit(x).cast("date")
    sums = used.agg(F.array_sort(F.collect_set("slice_id")).alias("slices_used"), own.alias("own"), F.min("start_day").alias("first"), F.max("end_day").alias("last"), F.max("method").alias("effective_method"))
    start, end = F.when(found, F.col("first")).otherwise(day(request.start)), F.when(found, F.col("last")).otherwise(day(request.end))
    other = F.coalesce(F.col("effective_method") != request.method, F.lit(False))
    return sums.select(
        F.when(found, F.col("own")).otherwise(F.lit(f"{request.start} - {request.end} {MERGED}")).alias("label"),
        F.when(found, F.lit("event")).otherwise(F.lit("range")).alias("mode"),
        start.alias("start_day"),
        end.alias("end_day"),
        (F.datediff(end, start) + 1).cast("long").alias("days"),
        "slices_used",
        F.lit(request.method).alias("requested_method"),
        "effective_method",
        other.alias("fallback"),
        F.when(other, FALLBACK).alias("notice"),
        F.when(F.size("slices_used") == 0, NO_SLICE).alias("unsupported_reason"),
    )


DRIVERS = ("road_density", "industry_proximity", "green_ratio", "impervious_ratio", "elevation", "slope", "wind_alignment")


def driver_matrix(values: DataFrame, cells: DataFrame, contexts: DataFrame, industries: DataFrame, wind_from: float | None) -> DataFrame:
    """(values' columns, DRIVERS): for each cell of a surface (cell_id, value, ..) with a context its seven drivers: densities,
    nearness to industry (0 from 5 km on), relief, and how straight the wind blows from the nearest industry."""
    wind = Y.wind_alignment(cells.select("cell_id", "lat", "lng"), industries, wind_from).select("cell_id", F.col("alignment").alias("wind_alignment"))
    near = F.greatest(F.lit(0.0), 1 - F.coalesce("nearest_industry_m", F.lit(0.0)) / 5000).alias("industry_proximity")
    own = contexts.select("cell_id", near, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in DRIVERS if c not in ("industry_proximity", "wind_alignment")])
    return values.join(own, "cell_id").join(wind, "cell_id", "left").fillna(0.0, ["wind_alignment"]).select(*values.columns, *DRIVERS)


def source_summaries(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, driver, coefficient, r2, n): standardised coefficients of a matrix's drivers, 4 digits."""
    return X.drivers(matrix, keys, "value", list(DRIVERS)).withColumns({c: F.round(c, 4) for c in ("coefficient", "r2")})


# series --------------------------------------------------------------------------------------------------------------
def replicated(rows: DataFrame, modeled: DataFrame, station: str = "station") -> DataFrame:
    """rows, and again under each modeled station (id, source_id) those of the station that it stands for."""
    twins = rows.join(modeled.select(F.col("id").alias("twin"), F.col("source_id").alias(station)), station)
    return rows.unionByName(twins.select(*[F.col("twin").alias(c) if c == station else F.col(c) for c in rows.columns]))


def forecast_slices(series: DataFrame, keys: list[str], horizons: tuple[int, ...] = (7, 30)) -> DataFrame:
    """(keys, horizon_days, supported, unavailable_reason, mae, rmse, points) for daily series with gaps filled (observed tells
    which days were): points are structs (day, value, lower, upper) with a band of 1.64 RMSE."""
    out, series = None, written(series, "series")  # gates, tests and horizons read it time and again
    about = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("observed").cast("double")).alias("ratio"))
    for h in horizons:
        short, sparse = F.col("n") < max(90, 3 * h), F.col("ratio") < 0.75
        reason = F.when(short, "Forecast icin en az 90 gunluk gunluk seri gerekir.").when(sparse, "Forecast icin gunluk seri dolulugu en az %75 olmalidir.")
        own = P.gated_forecasts(series, keys, h)
        points = own.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", F.round("value", 3).alias("value"), F.round("low", 3).alias("lower"), F.round("high", 3).alias("upper")))).alias("points"))
        tested = P.backtest(series, keys, h).select(*keys, F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"))
        some = about.withColumn("unavailable_reason", reason).join(points, keys, "left").join(tested, keys, "left")
        ok = F.col("unavailable_reason").isNull()
        some = some.select(*keys, F.lit(h).cast("long").alias("horizon_days"), ok.alias("supported"), "unavailable_reason", *[F.when(ok, F.col(c)).alias(c) for c in ("mae", "rmse")], "points")
        out = some if out is None else out.unionByName(some)
    return out


def impact_order(impacts: DataFrame, station: int | None = None, most: int = 6) -> DataFrame:
    """The first rows of an event's impact: the selected station, then exposed ones, each by distance."""
    chosen = F.col("station") == (F.lit(station) if station is not None else F.lit(None).cast("long"))
    return impacts.orderBy(F.coalesce(chosen, F.lit(False)).desc(), (F.col("status") == "exposed").desc(), "distance_km", "station").limit(most)


def reference_urls(events: DataFrame) -> DataFrame:
    """Different addresses that events refer to, in order; and, last, the source of fetched fires if there are any."""
    own = events.where("reference_url <> ''").select(F.lit(0).alias("part"), F.col("reference_url").alias("url")).distinct()
    known = F.when(F.max(F.col("source") == "NASA FIRMS"), "https://firms.modaps.eosdis.nasa.gov/api/").when(F.max(F.col("source") == "NASA EONET"), "https://eonet.gsfc.nasa.gov/api/v3/events")
    return own.unionByName(events.agg(known.alias("url")).where("url is not null").select(F.lit(1).alias("part"), "url")).orderBy("part", "url")


def issues(*lists: DataFrame) -> DataFrame:
    """All issues of the lists, one after the other."""
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out


# rows for export -----------------------------------------------------------------------------------------------------
ABOUT = ("pollutant", "slice_label", "analysis_mode", "training_scope")


def _about(fixed: dict[str, str]) -> list[Column]:
    return [F.lit(fixed[c]).alias(c) for c in ABOUT]


def surface_rows(cells: DataFrame, **fixed: str) -> DataFrame:
    """20 columns for each cell of a surface with its context."""
    own = ["value", "pollution_load", "exceedance_ratio", "road_density", "green_ratio", "impervious_ratio", "nearest_primary_road_m", "nearest_industry_m", "proximity_index", "mean_elevation_m", "slope_mean"]
    return cells.select("cell_id", *_about(fixed), F.lit(fixed["method"]).alias("method"), F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), *numbers(*own), F.coalesce("industry_count", F.lit(0)).cast("long").alias("industry_count_3km"))


def stats_rows(spots: DataFrame, found: DataFrame, keys: list[str], **fixed: str) -> DataFrame:
    """16 columns for each station of a slice's hot and cold spots."""
    whole = found.select(*keys, F.col("moran_i").alias("global_moran_i"), F.col("z").alias("global_moran_z_score"), F.col("p_value").alias("global_moran_p_value"))
    rows = spots.join(whole, keys, "left").withColumn("significance", 1 - F.col("p_value")).withColumnRenamed("z", "z_score")
    return rows.select(F.col("id").alias("station_id"), "station_name", *_about(fixed), "lat", "lng", *numbers("value", "z_score", "p_value", "significance"), F.col("class").alias("classification"), *numbers("global_moran_i", "global_moran_z_score", "global_moran_p_value"))


def risk_rows(cells: DataFrame, **fixed: str) -> DataFrame:
    """20 columns for each cell with a risk."""
    parts = ["pollution_component", "hotspot_component", "proximity_component", "green_deficit", "topographic_compression", "road_density", "green_ratio", "impervious_ratio", "nearest_primary_road_m", "nearest_industry_m"]
    score = cells.withColumnRenamed("score", "risk_score")
    return score.select("cell_id", *_about(fixed), F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), *numbers("risk_score"), F.col("label").alias("risk_label"), *numbers(*parts), F.coalesce("industry_count", F.lit(0)).cast("long").alias("industry_count_3km"))


def driver_rows(coefficients: DataFrame, keys: list[str], **fixed: str) -> DataFrame:
    """10 columns for each coefficient of a slice, the greatest first; the greatest is the dominant one, unless it is 0."""
    order = Window.partitionBy(*keys).orderBy(F.abs("coefficient").desc(), "driver")
    dominant = F.first(F.when(F.abs("coefficient") > 0, F.col("driver"))).over(order)
    rows = coefficients.withColumns({"dominant_driver": dominant, "driver_rank": F.row_number().over(order).cast("long")})
    renamed = rows.withColumnsRenamed({"coefficient": "standardized_coefficient", "r2": "model_score", "wind": "prevailing_wind_direction"})
    return renamed.select(*keys, *_about(fixed), *numbers("model_score", "prevailing_wind_direction"), F.col("driver").alias("driver_key"), "driver_label", *numbers("standardized_coefficient"), "dominant_driver", "driver_rank")
