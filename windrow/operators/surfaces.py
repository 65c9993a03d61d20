"""Surfaces of slices: gates, inverse distances and kriging of values and exceedances in one go, and each slice's figures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions import geo as G
from windrow.operators import spatial as X
from windrow.operators.nearby import paired
from windrow.operators.tables import written

#: Stations of a slice that its surfaces, and kriging, need at least; the share of days that they must have on average.
LEAST_STATIONS, LEAST_KRIGING, LEAST_COMPLETENESS = 4, 10, 0.7
#: Stations of which kriging's system, a square of their number, is still solved in one task.
MOST_KRIGING = 3000
# fixed values: why there is no surface
FEW = f"En az {LEAST_STATIONS} olculmus istasyon gerekir."
SPARSE = "Bucket butunlugu en az %70 olmalidir."
KRIGING_FEW = f"Kriging icin en az {LEAST_KRIGING} istasyon gerekir."
KRIGING_NO_VARIOGRAM = "Kriging variogram parametreleri kurulamadigi icin desteklenmiyor."
KRIGING_NO_ADVANTAGE = "Kriging LOOCV hatasi IDW'den dusuk degil."
KRIGING_UNSTABLE = "Kriging yuzeyi sayisal olarak stabil cozulmedi."
KRIGING_MANY = f"Kriging en fazla {MOST_KRIGING} istasyon icin cozulur."

TOP, POWER = 5, 2.0
SLICE = ("slice_id", "kind", "label", "start_day", "end_day")


def coverage_slices(events: DataFrame, start: str, end: str) -> DataFrame:
    """(slice_id, kind, label, start_day, end_day, from_day, to_day): every month of a coverage and every event (event_id,
    start_day, end_day) that touches it. Only the days from from_day to to_day lie in the coverage."""
    spark = events.sparkSession
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(first, "month"), F.trunc(F.greatest(first, last), "month"), F.expr("interval 1 month"))).alias("start_day"))
    label = F.date_format("start_day", "yyyy-MM")
    months = months.where(first <= last).select(F.concat(F.lit("month-"), label).alias("slice_id"), F.lit("month").alias("kind"), label.alias("label"), "start_day", F.last_day("start_day").alias("end_day"))
    own = events.select(F.col("event_id").cast("string").alias("label"), "start_day", "end_day").where((F.col("end_day") >= first) & (F.col("start_day") <= last))
    own = own.select(F.concat(F.lit("event-"), "label").alias("slice_id"), F.lit("event").alias("kind"), "label", "start_day", "end_day")
    return months.unionByName(own).withColumns({"from_day": F.greatest("start_day", first), "to_day": F.least("end_day", last)})


def observations(daily: DataFrame, slices: DataFrame, stations: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(slice_id, label, pollutant, scope, id, lat, lng, value, over, days, completeness) of each station and scope in each
    slice: its mean over the slice's days in the coverage, the share of its days over the pollutant's limit, and the
    share of the slice's days that it has.

    daily is (station, pollutant, day, value), stations (id, lat, lng, scope) with a row for each scope of a station. Slices
    meet days by equal joins, whatever slices overlap."""
    days = slices.select("slice_id", "label", (F.datediff("to_day", "from_day") + 1).alias("length"), F.explode(F.sequence("from_day", "to_day")).alias("day"))
    limit = F.coalesce(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("pollutant")], F.lit(float("inf")))
    per = daily.join(days, "day").groupBy("slice_id", "label", "length", "pollutant", "station").agg(F.avg("value").alias("value"), F.avg((F.col("value") > limit).cast("double")).alias("over"), F.countDistinct("day").alias("days"))
    at = stations.select(F.col("id").alias("station"), "lat", "lng", "scope")
    share = F.least(F.lit(1.0), F.col("days") / F.col("length"))
    return per.join(at, "station").select("slice_id", "label", "pollutant", "scope", F.col("station").alias("id"), "lat", "lng", "value", "over", "days", share.alias("completeness"))


KEYS = ["slice_id", "pollutant", "scope"]


def gated(obs: DataFrame, slices: DataFrame) -> DataFrame:
    """A row for every slice, pollutant and scope, also without observations: (SLICE, pollutant, scope, station_count,
    observation_count, mean_completeness, status, failure)."""
    per = obs.groupBy(*KEYS).agg(F.countDistinct("id").alias("station_count"), F.sum("days").alias("observation_count"), F.avg("completeness").alias("mean_completeness"))
    served = obs.select("pollutant", "scope").distinct()  # a few pollutants, two scopes
    every = slices.select(*SLICE).withColumn("one", F.lit(1)).join(served.withColumn("one", F.lit(1)), "one").drop("one")
    out = every.join(per, KEYS, "left").fillna(0, ["station_count", "observation_count"]).fillna(0.0, ["mean_completeness"])
    few, sparse = F.col("station_count") < LEAST_STATIONS, F.col("mean_completeness") < LEAST_COMPLETENESS
    status = F.when(few, "insufficient-observations").when(sparse, "insufficient-completeness").otherwise("ok")
    return out.select(*SLICE, "pollutant", "scope", "station_count", "observation_count", "mean_completeness", status.alias("status"), F.when(few, FEW).when(sparse, SPARSE).alias("failure"))


def idw_values(obs: DataFrame, cells: DataFrame, origin: tuple[float, float]) -> DataFrame:
    """(KEYS, cell_id, value, exceedance): inverse squared distances in the plane of an origin, of a metre at least."""
    (x, y), (u, v) = G.projected("lat", "lng", *origin), G.projected("olat", "olng", *origin)
    d = F.greatest(F.sqrt(F.pow(x - u, 2) + F.pow(y - v, 2)), F.lit(1.0))
    pairs = paired(cells.select("cell_id", "lat", "lng"), obs.select(*KEYS, F.col("lat").alias("olat"), F.col("lng").alias("olng"), F.col("value").alias("v"), "over"), "cell_id")
    w = pairs.select(*KEYS, "cell_id", "v", "over", (1 / F.pow(d, POWER)).alias("w"))
    mean = lambda c: F.sum(F.col(c) * F.col("w")) / F.sum("w")
    return w.groupBy(*KEYS, "cell_id").agg(F.round(mean("v"), 2).alias("value"), F.round(mean("over"), 4).alias("exceedance"))

def _system(p: np.ndarray, value: np.ndarray):
    """The variogram's function of stations at p, and the distances between them; None where none are apart."""
    d = X.apart(p, p)
    return (X.fitted(d, value), d) if (d > 0).any() else None


def kriging_values(obs: DataFrame, cells: pd.DataFrame, origin: tuple[float, float]) -> DataFrame:
    """(KEYS, idw_rmse, kriging_rmse, reason, values, exceedances) of each slice's stations: both surfaces of ordinary
    kriging, in order of the cells, where it may be used; else null and the reason.

    It may where there are LEAST_KRIGING stations and, each left out in turn, it errs less than inverse distances do. One
    factorisation serves values and exceedances at all cells. cells is a grid of bounded size and goes with the tasks' code; a
    group is a slice's stations, of which more than MOST_KRIGING aren't solved."""
    q = X.metres(cells, origin)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        row = {**{k: pdf[k].iloc[0] for k in KEYS}, "idw_rmse": None, "kriging_rmse": None, "reason": None, "values": None, "exceedances": None}
        n, v = pdf["id"].nunique(), pdf[["value", "over"]].to_numpy(float)
        p = X.metres(pdf, origin)
        if n < LEAST_KRIGING:
            row["reason"] = KRIGING_FEW
        elif n > MOST_KRIGING:
            row["reason"] = KRIGING_MANY
        elif (system := _system(p, v[:, 0])) is None:
            row["reason"] = KRIGING_NO_VARIOGRAM
        else:
            gamma, d = system
            w = np.where(np.eye(len(v), dtype=bool), 0.0, 1 / np.maximum(d, 1.0) ** POWER)
            idw = float(np.sqrt(((w @ v[:, 0] / w.sum(1) - v[:, 0]) ** 2).mean()))
            kriging = float(np.sqrt((X.left_out(gamma, d, v[:, 0]) ** 2).mean()))
            row |= {"idw_rmse": round(idw, 4), "kriging_rmse": round(kriging, 4)}
            if not kriging < idw:
                row["reason"] = KRIGING_NO_ADVANTAGE
            else:
                found = X.kriged(gamma, d, X.apart(p, q), v.T)
                if np.isfinite(found).all():
                    row |= {"values": np.round(found[0], 2) + 0.0, "exceedances": np.round(found[1], 4) + 0.0}
                else:
                    row["reason"] = KRIGING_UNSTABLE
        return pd.DataFrame([row]).astype({"idw_rmse": float, "kriging_rmse": float})

    schema = ", ".join([*[f"{k} {dict(obs.dtypes)[k]}" for k in KEYS], "idw_rmse double, kriging_rmse double, reason string, values array<double>, exceedances array<double>"])
    return obs.groupBy(*KEYS).applyInPandas(solve, schema)


def surface_slices(obs: DataFrame, slices: DataFrame, cells: DataFrame, origin: tuple[float, float]) -> tuple[DataFrame, DataFrame]:
    """(summaries, values) of every slice, pollutant and scope of observations.

    summaries has `gated`'s columns, kriging_reason, idw_rmse, kriging_rmse, mean, min, max, median, sd and `top`, the TOP cells
    of the surface of inverse distances; values has (KEYS, method, cell_id, value, exceedance). Slices that don't pass the gates
    have no surface; kriging is there where the gates allow it and it came out finite. cells is (i, cell_id, lat, lng)."""
    gates = gated(obs, slices)
    good = written(obs.join(gates.where("status = 'ok'").select(*KEYS), KEYS, "left_semi"), "observations")
    idw = written(idw_values(good, cells, origin), "idw")
    grid = cells.select("i", "cell_id", "lat", "lng").orderBy("i").toPandas()  # a grid of bounded size
    solved = written(kriging_values(good, grid, origin), "kriging")
    both = solved.where(F.col("values").isNotNull()).select(*KEYS, F.posexplode(F.arrays_zip("values", "exceedances")).alias("i", "v")).join(cells.select("i", "cell_id"), "i")
    values = idw.select(*KEYS, F.lit("idw").alias("method"), "cell_id", "value", "exceedance").unionByName(both.select(*KEYS, F.lit("kriging").alias("method"), "cell_id", F.col("v.values").alias("value"), F.col("v.exceedances").alias("exceedance")))
    two = {"mean": F.avg("value"), "min": F.min("value"), "max": F.max("value"), "median": F.median("value"), "sd": F.coalesce(F.stddev_samp("value"), F.lit(0.0))}
    figures = idw.groupBy(*KEYS).agg(*[F.round(x, 2).alias(n) for n, x in two.items()])
    ranked = idw.withColumn("r", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("value").desc(), "cell_id"))).where(F.col("r") <= TOP)
    top = ranked.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "cell_id", "value"))), lambda x: F.struct(x.cell_id.alias("cell_id"), x.value.alias("value"))).alias("top"))
    about = solved.select(*KEYS, F.col("reason").alias("kriging_reason"), "idw_rmse", "kriging_rmse")
    summaries = gates.withColumn("mean_completeness", F.round("mean_completeness", 4))
    for part in (about, figures, top):
        summaries = summaries.join(part, KEYS, "left")
    return summaries, values
