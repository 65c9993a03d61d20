"""Packages of analyses: surfaces, statistics, risks, drivers and forecasts of every slice, pollutant and scope from shared tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions import geo as G
from windrow.functions import scalars as S
from windrow.operators import forecast as P
from windrow.operators import layers as Y
from windrow.operators import slices as L
from windrow.operators import spatial as X
from windrow.operators import surfaces as U
from windrow.operators.nearby import paired
from windrow.operators.tables import written

KEYS = U.KEYS
WHERE = [*U.SLICE, "pollutant", "scope"]
# fixed values: why a slice has no statistics
STATS_FEW = "Moran ve Gi* icin en az 6 olculmus istasyon gerekir."
STATS_FLAT = "Moran hesabi icin yeterli degiskenlik bulunmuyor."


@dataclass(frozen=True)
class Inputs:
    """What packages are built from: daily (station, pollutant, day, value), stations (id, lat, lng, scope; a row for each scope),
    events (event_id, start_day, end_day), meteo (station, day, wind_dir), cells (i, cell_id, lat, lng), contexts by cell_id
    and industries (id, lat, lng); the days that are covered, and the origin of the plane."""

    daily: DataFrame
    stations: DataFrame
    events: DataFrame
    meteo: DataFrame
    cells: DataFrame
    contexts: DataFrame
    industries: DataFrame
    start: str
    end: str
    origin: tuple[float, float]
    limits: dict[str, float] | None = None


def stats_slices(obs: DataFrame, slices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summaries, stations): Moran's I of every slice, pollutant and scope with its gates, shuffles seeded by the slice's label;
    and Gi* of the stations of those that have it."""
    found = L.stats(obs, [*KEYS, "label"], "label").drop("label")
    served = obs.select("pollutant", "scope").distinct().withColumn("one", F.lit(1))
    every = slices.select(*U.SLICE).withColumn("one", F.lit(1)).join(served, "one").drop("one")
    out = every.join(found, KEYS, "left").fillna(0, ["station_count", "observation_count"]).fillna(0.0, ["mean_completeness"])
    few, sparse = F.col("station_count") < 6, F.col("mean_completeness") < U.LEAST_COMPLETENESS
    status = F.when(few, "insufficient-observations").when(sparse, "insufficient-completeness").otherwise(F.col("status"))
    failure = F.when(few, STATS_FEW).when(sparse, U.SPARSE).when(F.col("moran_i").isNull(), STATS_FLAT)
    out = out.withColumns({"status": status, "failure": failure, "mean_completeness": F.round("mean_completeness", 4)})
    ok = out.where("status = 'ok'").select(*KEYS)
    good = obs.join(ok, KEYS, "left_semi")
    spots = X.getis_ord(good, KEYS).join(good.select(*KEYS, "id", "lat", "lng", F.round("value", 2).alias("value")), [*KEYS, "id"])
    about = slices.select(*U.SLICE)
    spots = spots.join(about, "slice_id").select(*WHERE, F.col("id").alias("station"), "lat", "lng", "value", F.round("z", 4).alias("z"), F.round("p_value", 4).alias("p_value"), "class")
    return out, spots


def hotspot_components(spots: DataFrame, radii: DataFrame, cells: DataFrame, origin: tuple[float, float]) -> DataFrame:
    """(KEYS, cell_id, hotspot): inverse-distance mean of the strengths of each slice's hot stations in its radius (10 km at least)."""
    hot = spots.where("z > 0").join(radii.select(*KEYS, "radius"), KEYS).select(*KEYS, F.col("lat").alias("hlat"), F.col("lng").alias("hlng"), F.least(F.lit(1.0), F.col("z") / 2.58).alias("strength"), F.greatest(F.coalesce("radius", F.lit(0.0)), F.lit(Y.REACH_M)).alias("reach"))
    (x, y), (u, v) = G.projected("lat", "lng", *origin), G.projected("hlat", "hlng", *origin)
    d = F.greatest(F.sqrt(F.pow(x - u, 2) + F.pow(y - v, 2)), F.lit(1.0))
    near = paired(cells.select("cell_id", "lat", "lng"), hot, "cell_id").withColumn("d", d).where("d <= reach").withColumn("w", 1 / F.pow("d", F.lit(2)))
    return near.groupBy(*KEYS, "cell_id").agg((F.sum(F.col("strength") * F.col("w")) / F.sum("w")).alias("hotspot"))


def reliefs(contexts: DataFrame) -> DataFrame:
    """(cell_id, green_deficit, relief, proximity) of each cell with a context: how much green lacks, and how low and flat it
    lies among all cells; 0 where all are alike."""
    ends = contexts.agg(*[f(F.coalesce(c, F.lit(0.0))).alias(f"{c}_{n}") for c in ("slope", "elevation") for n, f in (("lo", F.min), ("hi", F.max))]).withColumn("one", F.lit(1))
    c = contexts.withColumn("one", F.lit(1)).join(ends, "one")
    inverse = lambda n: F.coalesce(1 - F.try_divide(F.coalesce(n, F.lit(0.0)) - F.col(f"{n}_lo"), F.nullif(F.col(f"{n}_hi") - F.col(f"{n}_lo"), F.lit(0.0))), F.lit(0.0))
    share = lambda n: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(n, F.lit(0.0))))
    return c.select("cell_id", (1 - share("green_ratio")).alias("green_deficit"), (0.6 * inverse("slope") + 0.4 * inverse("elevation")).alias("relief"), share("proximity_index").alias("proximity"))


def risk_slices(idw: DataFrame, slices: DataFrame, spots: DataFrame, radii: DataFrame, cells: DataFrame, contexts: DataFrame, origin: tuple[float, float], limits: dict[str, float]) -> DataFrame:
    """(WHERE, cell_id, score, label, pollution, hotspot, proximity, green_deficit, relief) of every cell of a surface (KEYS,
    cell_id, value): how far it is over one and a half times the pollutant's limit, with hotspots, sources, green and relief."""
    limit = F.coalesce(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("pollutant")], F.lit(1.0))
    pollution = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / F.greatest(limit * 1.5, F.lit(1.0))))
    rows = idw.withColumn("pollution", pollution).join(reliefs(contexts), "cell_id", "left").join(hotspot_components(spots, radii, cells, origin), [*KEYS, "cell_id"], "left")
    parts = {"pollution": 0.4, "hotspot": 0.2, "proximity": 0.2, "green_deficit": 0.1, "relief": 0.1}
    rows = rows.fillna(0.0, list(parts)).withColumn("score", sum(F.col(c) * w for c, w in parts.items()))
    return rows.join(slices.select(*U.SLICE[:1], "kind", "start_day", "end_day", F.col("label").alias("slice_label")), "slice_id").select("slice_id", "kind", F.col("slice_label"), "start_day", "end_day", "pollutant", "scope", "cell_id", F.round("score", 4).alias("score"), S.risk_label("score").alias("label"), *[F.round(c, 4).alias(c) for c in parts])


def winds(meteo: DataFrame, stations: DataFrame, slices: DataFrame) -> DataFrame:
    """(slice_id, scope, wind): the mean direction that the wind comes from in each slice's days, over a scope's stations."""
    days = slices.select("slice_id", F.explode(F.sequence("start_day", "end_day")).alias("day"))
    a = F.radians("wind_dir")
    own = meteo.where("wind_dir is not null").join(stations.select(F.col("id").alias("station"), "scope"), "station").join(days, "day")
    return own.groupBy("slice_id", "scope").agg(F.round(F.pmod(F.degrees(F.atan2(F.sum(F.sin(a)), F.sum(F.cos(a)))), F.lit(360.0)), 2).alias("wind"))


def driver_slices(idw: DataFrame, slices: DataFrame, i: Inputs) -> DataFrame:
    """(WHERE, driver, coefficient, r2, n, wind): what goes with a slice's surface, by standardised coefficients of the drivers
    of each cell. Cells find their nearest industry once; only the wind's share is a slice's own."""
    near = Y.donated(i.cells.select(F.col("cell_id").alias("id"), "lat", "lng"), i.industries.select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("id"), "lat", "lng", F.col("lat").alias("ilat"), F.col("lng").alias("ilng")), ["ilat", "ilng"])
    placed = i.cells.select("cell_id", "lat", "lng").join(near.withColumnRenamed("id", "cell_id"), "cell_id", "left")
    towards = placed.select("cell_id", "metres", G.bearing("ilat", "ilng", "lat", "lng").alias("bearing"))
    proximity = F.greatest(F.lit(0.0), 1 - F.coalesce("metres", "nearest_industry_m", F.lit(0.0)) / 5000).alias("industry_proximity")
    fixed = [c for c in L.DRIVERS if c not in ("industry_proximity", "wind_alignment")]
    about = written(i.contexts.join(towards, "cell_id", "left").select("cell_id", "metres", "bearing", proximity, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in fixed]), "drivers")
    rows = idw.join(about, "cell_id").join(winds(i.meteo, i.stations, slices), ["slice_id", "scope"], "left")
    straight = F.greatest(F.lit(0.0), F.cos(F.radians(G.angular_difference(F.col("bearing"), F.pmod(F.col("wind") + 180, F.lit(360.0))))))
    blown = F.when((F.col("metres") <= Y.REACH_M) & F.col("wind").isNotNull(), straight).otherwise(0.0)
    matrix = rows.withColumn("wind_alignment", blown)
    found = X.drivers(matrix.select(*KEYS, "value", *L.DRIVERS), KEYS, "value", list(L.DRIVERS)).withColumns({c: F.round(c, 4) for c in ("coefficient", "r2")})
    return found.join(winds(i.meteo, i.stations, slices), ["slice_id", "scope"], "left").join(slices.select(*U.SLICE), "slice_id").select(*WHERE, "driver", "coefficient", "r2", "n", "wind")


def network_series(daily: DataFrame, stations: DataFrame, start: str, end: str) -> DataFrame:
    """(pollutant, scope, day, value, observed): means over the stations on days with two or more of them, for every day that is
    covered; gaps are on the line between their neighbours, the ends as the nearest."""
    own = daily.join(stations.select(F.col("id").alias("station"), "scope"), "station")
    seen = own.groupBy("pollutant", "scope", "day").agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
    ends = F.lit(start).cast("date"), F.lit(end).cast("date")
    frame = seen.select("pollutant", "scope").distinct().select("*", F.explode(F.array(*ends)).alias("day")).distinct()
    marked = seen.where(F.col("day").between(*ends)).join(frame, ["pollutant", "scope", "day"], "full")
    return P.filled(marked, ["pollutant", "scope"], value="v").withColumnRenamed("v", "value")


def build(i: Inputs) -> dict[str, DataFrame]:
    """The tables of all packages: slices, surfaces, stats, stations, risks, drivers, forecasts, cells, contexts.

    Observations, surfaces and statistics are worked out once each and written; risks, drivers and summaries read them."""
    limits = i.limits or S.THRESHOLDS
    slices = written(U.coverage_slices(i.events, i.start, i.end), "slices")
    obs = written(U.observations(i.daily, slices, i.stations, limits), "observations")
    cells, contexts = written(i.cells, "cells"), written(i.contexts, "contexts")
    shared = Inputs(i.daily, i.stations, i.events, i.meteo, cells, contexts, i.industries, i.start, i.end, i.origin, limits)
    summaries, values = U.surface_slices(obs, slices, cells, i.origin)
    stats, spots = stats_slices(obs, slices)
    stats, spots = written(stats, "stats"), written(spots, "spots")
    idw = written(values.where("method = 'idw'").select(*KEYS, "cell_id", "value"), "surface")
    series = written(network_series(i.daily, i.stations, i.start, i.end), "series")
    counted = spots.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("hotspots"))
    found = stats.join(counted, KEYS, "left").fillna(0, ["hotspots"])
    return {
        "slices": L.with_stats(summaries, found, KEYS),
        "surfaces": values.join(slices.select(*U.SLICE), "slice_id").select(*WHERE, "method", "cell_id", "value", "exceedance"),
        "stats": found.select(*WHERE, *[c for c in found.columns if c not in WHERE]),
        "stations": spots,
        "risks": risk_slices(idw, slices, spots, stats, cells, contexts, i.origin, limits),
        "drivers": driver_slices(idw, slices, shared),
        "forecasts": L.forecast_slices(series, ["pollutant", "scope"]),
        "cells": cells,
        "contexts": contexts,
    }


def descriptors(slices: DataFrame) -> DataFrame:
    """(pollutant, scope, months, usable_months, events): what each package holds."""
    return slices.groupBy("pollutant", "scope").agg(F.count_if(F.col("kind") == "month").alias("months"), F.count_if((F.col("kind") == "month") & (F.col("status") == "ok")).alias("usable_months"), F.count_if(F.col("kind") == "event").alias("events"))
