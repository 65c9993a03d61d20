"""Whole datasets: built from files, written by table and pollutant with a manifest, read by what a request needs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from windrow.functions import geo as G
from windrow.operators import grids as B
from windrow.operators import layers as Y
from windrow.operators import packages as K
from windrow.operators import slices as L
from windrow.operators.quality import deduplicated
from windrow.operators.tables import written
from windrow.sources import readers

SERIES = "series"
# fixed values: where a station stands of which only measurements are known
DISTRICT, LAT, LNG, ELEVATION_M = "Bursa", 40.19, 29.06, 100.0


def built(spark: SparkSession, air: str, meteo: str | None = None, contexts: str | None = None, events: str | None = None, stations: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of a dataset from local files; stations are made up from the measurements where there is no table of them."""
    series = deduplicated(readers.air_quality(spark, air), ["station", "pollutant", "ts"], "ord").drop("ord")
    own = series.groupBy(F.col("station").alias("id")).agg(F.array_sort(F.collect_set("pollutant")).alias("pollutants"))
    made = own.select("id", F.initcap(F.replace(F.col("id"), F.lit("-"), F.lit(" "))).alias("name"), F.lit(DISTRICT).alias("district"), F.lit(LAT).alias("lat"), F.lit(LNG).alias("lng"), F.lit(ELEVATION_M).alias("elevation_m"), "pollutants")
    tables = {SERIES: series, "stations": made if stations is None else stations}
    tables["coverage"] = series.agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    for name, path, read in (("meteo", meteo, readers.meteo), ("contexts", contexts, readers.context_metrics), ("events", events, readers.events)):
        if path:
            tables[name] = read(spark, path)
    return tables


def manifest(tables: dict[str, DataFrame], version: str) -> DataFrame:
    """(table, pollutant, n, version): the rows of each table, by pollutant for the series."""
    out = None
    for name, df in sorted(tables.items()):
        p = F.col("pollutant") if name == SERIES else F.lit(None).cast("string")
        rows = df.groupBy(p.alias("pollutant")).agg(F.count(F.lit(1)).alias("n"))
        rows = rows.select(F.lit(name).alias("table"), "pollutant", "n", F.lit(version).alias("version"))
        out = rows if out is None else out.unionByName(rows)
    return out


def write(tables: dict[str, DataFrame], path: str, version: str) -> None:
    """Each table as Parquet under its name, the series by pollutant; the manifest last, so that it stands for whole data."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(*(["pollutant"] if name == SERIES else [])).parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    manifest({name: spark.read.parquet(f"{path}/{name}") for name in tables}, version).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read(spark: SparkSession, path: str, names: list[str], pollutant: str | None = None, version: str | None = None) -> dict[str, DataFrame]:
    """The named tables that the dataset has, the series of one pollutant only if it is given.

    ValueError if the dataset is of another version than the one asked for."""
    rows = spark.read.schema("table string, pollutant string, n long, version string").json(f"{path}/manifest")
    there = {r.table: r.version for r in rows.groupBy("table").agg(F.max("version").alias("version")).collect()}  # a row a table
    if version is not None and set(there.values()) != {version}:
        raise ValueError(f"the dataset has version {', '.join(sorted(set(there.values())))}, not {version}")
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in names if n in there}
    if SERIES in tables and pollutant:
        tables[SERIES] = tables[SERIES].where(F.col("pollutant") == pollutant)
    return tables


# versions: tables are written beside older ones and seen only once their manifest is there --------------------------------
def _files(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _published(spark: SparkSession, path: str) -> list[str]:
    """The published versions' folders, the oldest first: those whose manifest was written to its end."""
    folder, files = _files(spark, f"{path}/manifests")
    if not files.exists(folder):
        return []
    names = sorted(s.getPath().getName() for s in files.listStatus(folder))
    return [n for n in names if files.exists(_files(spark, f"{path}/manifests/{n}/_SUCCESS")[0])]


def publish(tables: dict[str, DataFrame], path: str, about: DataFrame, partitions: dict[str, list[str]] | None = None) -> str:
    """Writes tables as a new version of what stands at a path, and returns the version's name.

    Tables go into a folder of their own. Then `about`, a small table that describes them, is written as the manifest, whose
    mark of success is the one file that makes the version seen. Until then, and if the write breaks off, readers go on with
    the version before; nothing of it is touched. One writer at a time."""
    spark = about.sparkSession
    _, files = _files(spark, path)
    taken = [s.getPath().getName() for part in ("manifests", "versions") if files.exists(_files(spark, f"{path}/{part}")[0]) for s in files.listStatus(_files(spark, f"{path}/{part}")[0])]
    name = f"v{max([int(n[1:]) for n in taken if n[1:].isdigit()], default=0) + 1:08d}"
    schemas = [(table, df.schema.json()) for table, df in tables.items()]  # a table without rows has no file that tells
    spark.createDataFrame(schemas, "table string, schema string").coalesce(1).write.json(f"{path}/versions/{name}/schemas")
    for table, df in tables.items():
        df.write.partitionBy(*(partitions or {}).get(table, [])).parquet(f"{path}/versions/{name}/{table}")
    about.coalesce(1).write.json(f"{path}/manifests/{name}")
    return name


def current(spark: SparkSession, path: str, names: list[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(manifest, the named tables) of the version that was published last. FileNotFoundError if there is none."""
    versions = _published(spark, path)
    if not versions:
        raise FileNotFoundError(f"nothing is published at {path}")
    at = f"{path}/versions/{versions[-1]}"
    schemas = {r.table: StructType.fromJson(json.loads(r.schema)) for r in spark.read.schema("table string, schema string").json(f"{at}/schemas").collect()}  # a row a table
    return spark.read.json(f"{path}/manifests/{versions[-1]}"), {n: spark.read.schema(schemas[n]).parquet(f"{at}/{n}") for n in names}


def cleared(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes all but the last versions, and what broken writes left behind; the names of what went. Readers of the
    versions that stay are not disturbed."""
    folder, files = _files(spark, f"{path}/versions")
    if not files.exists(folder):
        return []
    stay = set(_published(spark, path)[-keep:])
    gone = [n for n in (s.getPath().getName() for s in files.listStatus(folder)) if n not in stay]
    for n in gone:
        files.delete(_files(spark, f"{path}/manifests/{n}")[0], True)
        files.delete(_files(spark, f"{path}/versions/{n}")[0], True)
    return sorted(gone)


def publish_dataset(tables: dict[str, DataFrame], path: str, version: str) -> str:
    """Publishes a dataset's tables, the series by pollutant; its manifest is that of `manifest`."""
    return publish(tables, path, manifest(tables, version), {SERIES: ["pollutant"]})


# from a dataset to packages ------------------------------------------------------------------------------------------
# fixed values: the sources of stations that each scope counts
SCOPE_SOURCES = {"physical": ("official", "municipal-official"), "all": ("official", "municipal-official", "municipal-sensor")}
POINTS = "array<array<double>>"  # pairs of lat, lng
LAYER_SCHEMAS = {"roads": f"id string, category string, coordinates {POINTS}", "industries": "id string, lat double, lng double", "greens": f"id string, coordinates {POINTS}", "elevations": f"id string, value double, coordinates {POINTS}", "stations": "id string, name string, district string, source string, lat double, lng double, elevation_m double"}


def scoped(stations: DataFrame) -> DataFrame:
    """(id, lat, lng, scope): a row for each scope that a station's source counts to; official without any."""
    out = None
    for scope, sources in SCOPE_SOURCES.items():
        source = F.coalesce("source", F.lit("official")) if "source" in stations.columns else F.lit("official")
        rows = stations.where(source.isin(*sources)).select("id", "lat", "lng", F.lit(scope).alias("scope"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _shapes(rows: DataFrame, origin: tuple[float, float]) -> DataFrame:
    """rows with the area and the place of the centroid of their outline; those with under three corners go."""
    ring = F.transform("coordinates", lambda p: F.struct(p[0].alias("lat"), p[1].alias("lng")))
    shaped = Y.polygons(rows.where(F.size("coordinates") >= 3).withColumn("ring", ring), "ring", *origin)
    return shaped.withColumns({"lat": origin[0] + F.degrees(F.col("cy") / G.EARTH_M), "lng": origin[1] + F.degrees(F.col("cx") / (G.EARTH_M * F.cos(F.radians(F.lit(origin[0])))))})


def package_inputs(tables: dict[str, DataFrame], boundary: DataFrame | None = None, km: float = B.CELL_KM) -> K.Inputs:
    """What packages are built from, of a dataset's tables: its coverage, and a grid over the boundary or all its features, with the
    surroundings of each cell. Layers, weather and events that a dataset lacks count as empty."""
    spark = tables[SERIES].sparkSession
    empty = lambda schema: spark.createDataFrame([], schema)
    layer = {n: tables.get(n, empty(LAYER_SCHEMAS[n])) for n in ("roads", "industries", "greens", "elevations")}
    corner = F.explode("coordinates").alias("p")
    points = tables["stations"].select("lat", "lng")
    for n in ("roads", "greens", "elevations"):
        points = points.unionByName(layer[n].select(corner).select(F.col("p")[0].alias("lat"), F.col("p")[1].alias("lng")))
    outline = boundary if boundary is not None else empty("rings array<array<struct<x: double, y: double>>>")
    side = B.extent(outline, points).first()
    origin = (side.south, side.west)
    number = F.row_number().over(Window.orderBy("cell_id")) - 1  # a grid of bounded size
    cells = written(B.clipped(outline, points, km).select(number.alias("i"), "cell_id", "lat", "lng"), "cells")
    path = F.transform("coordinates", lambda p: F.struct(p[0].alias("lat"), p[1].alias("lng")))
    sides = Y.segments(layer["roads"].select("id", "category", path.alias("path")))
    contexts = Y.cell_contexts(cells, sides, layer["industries"], _shapes(layer["greens"], origin), _shapes(layer["elevations"], origin).withColumnRenamed("value", "height"), origin)
    daily = tables[SERIES].groupBy("station", "pollutant", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))
    ends = daily.agg(F.min("day").alias("start"), F.max("day").alias("end")).first()
    events = tables.get("events", empty("event_id string, start_day date, end_day date"))
    meteo = tables.get("meteo", empty("station string, ts timestamp, wind_dir double"))
    weather = meteo.select("station", F.to_date("ts").alias("day"), "wind_dir") if "ts" in meteo.columns else meteo
    return K.Inputs(daily, scoped(tables["stations"]), events, weather, cells, contexts, layer["industries"], str(ends.start), str(ends.end), origin)


# packages of analyses ------------------------------------------------------------------------------------------------
PARTS = ("slices", "surfaces", "stats", "stations", "risks", "drivers", "forecasts")
GRID_PARTS = ("cells", "contexts")


def publish_packages(tables: dict[str, DataFrame], path: str, version: str, start: str, end: str) -> str:
    """Publishes the tables of `packages.build` by pollutant and scope; the manifest has a row for each package."""
    fixed = {"dataset_version": version, "coverage_start": start, "coverage_end": end}
    slices = written(tables["slices"], "slices")
    about = K.descriptors(slices).select("*", *[F.lit(v).alias(k) for k, v in fixed.items()])
    return publish(tables | {"slices": slices}, path, about, {n: ["pollutant", "scope"] for n in PARTS})


def published_packages(spark: SparkSession, path: str, pollutant: str, scopes: tuple[str, ...] = L.SCOPES) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(manifest, tables) of one pollutant, as `slices.resolved` takes them: only its folders and those of the scopes are read."""
    own = (F.col("pollutant") == pollutant) & F.col("scope").isin(*scopes)
    about, tables = current(spark, path, [*PARTS, *GRID_PARTS])
    found = {n: tables[n].where(own) for n in PARTS} | {n: tables[n] for n in GRID_PARTS}
    # statistics of a request are the stations'; what a whole slice has is beside them
    return about.where(own), found | {"stats": found["stations"], "stats_slices": found["stats"]}


# statistics alone -----------------------------------------------------------------------------------------------------
def packages(slices: DataFrame) -> DataFrame:
    """One row per pollutant and scope of slices (pollutant, scope, kind month or event, status): how many there are."""
    usable = (F.col("kind") == "month") & (F.col("status") == "ok")
    counts = {"months": F.col("kind") == "month", "usable_months": usable, "events": F.col("kind") == "event"}
    return slices.groupBy("pollutant", "scope").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def write_packages(slices: DataFrame, path: str) -> None:
    """Slices by pollutant and scope, and their manifest."""
    slices.write.mode("overwrite").partitionBy("pollutant", "scope").parquet(f"{path}/packages")
    packages(slices.sparkSession.read.parquet(f"{path}/packages")).coalesce(1).write.mode("overwrite").json(f"{path}/packages-manifest")


def read_packages(spark: SparkSession, path: str, pollutant: str, scopes: tuple[str, ...] = L.SCOPES) -> tuple[DataFrame, DataFrame]:
    """(manifest, slices) of one pollutant: only its folders and those of the scopes are read."""
    own = (F.col("pollutant") == pollutant) & F.col("scope").isin(*scopes)
    return spark.read.json(f"{path}/packages-manifest").where(own), spark.read.parquet(f"{path}/packages").where(own)


def build_packages(daily: DataFrame, stations: DataFrame, slices: DataFrame, path: str) -> None:
    """The statistics of every pollutant, scope and slice, with their gates, as packages: stations has (id, lat, lng, scope), where a
    station may be in several scopes; slices has (slice_id, kind, start_day, end_day)."""
    keys = ["slice_id", "pollutant", "scope"]
    # shuffles are seeded by the slice's label: its month or its event's id
    label = F.regexp_replace("slice_id", "^(month|event)-", "")
    out = None
    for scope in L.SCOPES:
        obs = L.observations(daily, slices, stations.where(F.col("scope") == scope), ["pollutant"]).withColumn("scope", F.lit(scope))
        obs = obs.join(slices.select("slice_id", label.alias("label")), "slice_id")
        own = L.stats(obs, [*keys, "label"], "label").drop("label")
        out = own if out is None else out.unionByName(own)
    write_packages(out.join(slices.select("slice_id", "kind", "start_day", "end_day"), "slice_id"), path)


# layers and legacy files ---------------------------------------------------------------------------------------------
LAYERS = ("neighborhoods", "roads", "industries", "greens", "elevations")


def read_layers(spark: SparkSession, path: str, enabled: set[str], version: str | None = None) -> dict[str, DataFrame]:
    """The map layers that are asked for and there; nothing is read of the others."""
    wanted = [n for n in LAYERS if n in enabled]
    return read(spark, path, wanted, version=version) if wanted else {}


def with_layers(tables: dict[str, DataFrame], layers: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """tables with the layers that were read in place of their own."""
    return tables | {n: df for n, df in layers.items() if n in LAYERS}


def legacy(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """The named arrays of a dataset that is one JSON object, each as a table. Such a file is read by one task; write() deals it."""
    whole = spark.read.json(path, multiLine=True)
    return {n: whole.select(F.inline(n)) for n in names if n in whole.columns}
