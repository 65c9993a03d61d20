"""Readers of station files: CSV with aliased columns, JSON collections, workbooks; and partitioned writers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.functions import scalars as S
from windrow.operators.layers import polygons

# fixed values: accepted column names, in order of preference
AIR = {
    "station": ("station_id", "stationId", "station_name", "Station", "Station_Name"),
    "pollutant": ("pollutant", "parameter", "Parameter"),
    "value": ("value", "Value", "measurement"),
    "timestamp": ("timestamp", "Timestamp", "read_time", "ReadTime", "date"),
    "unit": ("unit", "Unit"),
    "quality_flag": ("quality_flag", "qualityFlag"),
    "source": ("source", "Source"),
}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path of any file system that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def place() -> Column:
    """Where a row stands in the files that it is read from: its file, the block of it that a task reads, and the row's number
    within the task. It orders rows as the files have them, in whatever order tasks end; select it in the scan itself."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column a string; a byte-order mark before the first name is dropped."""
    df = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8")
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def picked(df: DataFrame, names: tuple[str, ...], default: str | None = None) -> Column:
    """The first of the named columns that exists and is not empty."""
    there = [F.nullif(F.col(f"`{c}`"), F.lit("")) for c in names if c in df.columns]
    return F.coalesce(*there, F.lit(default).cast("string"))


def air_quality(spark: SparkSession, path: str) -> DataFrame:
    """Measurements with ids, units and times made uniform; rows without station, pollutant, value or time go."""
    df = csv(spark, path)
    raw = df.select(*[picked(df, names).alias(c) for c, names in AIR.items()], F.monotonically_increasing_id().alias("ord"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    pollutant = F.replace(F.col("pollutant"), F.lit("PM2,5"), F.lit("PM2.5"))
    value = S.converted(S.lenient_double("value"), F.coalesce("unit", F.lit("")), pollutant)
    return raw.select(
        S.slug("station").alias("station"),
        pollutant.alias("pollutant"),
        S.parsed_timestamp("timestamp").alias("ts"),
        F.round(value, 4).alias("value"),
        S.canonical_unit(pollutant).alias("unit"),
        F.coalesce("quality_flag", F.lit("valid")).alias("quality_flag"),
        F.coalesce("source", "file").alias("source"),
        "ord",
    ).dropna(subset=["station", "pollutant", "ts", "value"])


def _numbers(df: DataFrame, columns: dict[str, tuple[tuple[str, ...], float | None]]) -> list[Column]:
    """Lenient doubles by name: (accepted column names, default)."""
    return [F.coalesce(S.lenient_double(picked(df, names)), F.lit(default).cast("double")).alias(c) for c, (names, default) in columns.items()]


def _file() -> Column:
    return F.element_at(F.split(F.input_file_name(), "/"), -1)


# fixed values: accepted column names and defaults
STATION = ("station_id", "stationId", "station_name")
METEO = {
    "temperature": (("temperature_c", "temperature", "Temperature"), None),
    "humidity": (("humidity_pct", "humidity", "Humidity"), None),
    "wind_speed": (("wind_speed_ms", "wind_speed", "WindSpeed"), None),
    "wind_dir": (("wind_dir_deg", "wind_direction", "WindDirection"), None),
    "precipitation": (("precipitation_mm", "precipitation", "Precipitation"), None),
}
CONTEXT = {
    "building_density": (("building_density", "buildingDensity"), 0.0),
    "road_density": (("road_density", "roadDensity"), 0.0),
    "green_ratio": (("green_ratio", "greenRatio"), 0.0),
    "impervious_ratio": (("impervious_ratio", "imperviousRatio"), 0.0),
    "mean_elevation": (("mean_elevation", "meanElevation"), 0.0),
    "slope_mean": (("slope_mean", "slopeMean"), 0.0),
}
EVENT = {
    "lat": (("lat", "center_lat", "centerLat"), 0.0),
    "lng": (("lng", "center_lng", "centerLng"), 0.0),
    "radius_km": (("radius_km", "radiusKm"), 10.0),
    "confidence": (("confidence", "Confidence"), 0.75),
}


def meteo(spark: SparkSession, path: str) -> DataFrame:
    """Weather by station and time; a number that is missing stays null, rows without station or time go."""
    df = csv(spark, path)
    at = S.parsed_timestamp(picked(df, ("timestamp", "Timestamp", "read_time", "ReadTime")))
    out = df.select(S.slug(picked(df, (*STATION, "Station"))).alias("station"), at.alias("ts"), *_numbers(df, METEO), F.coalesce(picked(df, ("source", "Source")), _file()).alias("source"))
    return out.dropna(subset=["station", "ts"])


def context_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Surroundings of stations by radius (500 m where none is given); missing numbers are 0."""
    df = csv(spark, path)
    whole = lambda names, default: F.coalesce(S.lenient_double(picked(df, names)), F.lit(float(default))).cast("int")
    out = df.select(S.slug(picked(df, STATION)).alias("station"), whole(("radius_m", "radiusM"), 500).alias("radius_m"), *_numbers(df, CONTEXT), whole(("industry_count", "industryCount"), 0).alias("industry_count"))
    return out.dropna(subset=["station"])


def events(spark: SparkSession, path: str) -> DataFrame:
    """The event catalogue; events without an id are numbered in the file's order. A catalogue is a small table."""
    df = csv(spark, path).withColumn("_ord", F.monotonically_increasing_id())
    own = F.concat(F.lit("event-"), F.row_number().over(Window.orderBy("_ord")).cast("string"))
    day = lambda *names: F.to_date(S.parsed_timestamp(picked(df, names)))
    out = df.withColumn("event_id", F.coalesce(picked(df, ("event_id", "eventId")), own))
    return out.select(
        "event_id",
        picked(df, ("event_type", "eventType"), "fire").alias("kind"),
        F.coalesce(picked(df, ("name", "Name")), "event_id").alias("name"),
        day("start_date", "startDate").alias("start_day"),
        day("end_date", "endDate").alias("end_day"),
        *_numbers(df, EVENT),
        F.coalesce(S.lenient_double(picked(df, ("hotspot_count", "hotspotCount"))), F.lit(0.0)).cast("int").alias("hotspot_count"),
        F.coalesce(picked(df, ("source", "Source")), _file()).alias("source"),
        picked(df, ("note", "Note"), "").alias("note"),
    )


MAP = "elements array<struct<type: string, id: long, lat: double, lon: double, geometry: array<struct<lat: double, lon: double>>, tags: map<string, string>>>"


def map_elements(spark: SparkSession, path: str) -> DataFrame:
    """(type, id, lat, lng, path, tags) of a map export in JSON: path is an array of structs (lat, lng)."""
    e = spark.read.schema(MAP).json(path, multiLine=True).select(F.explode("elements").alias("e"))
    line = F.transform("e.geometry", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lng")))
    return e.select("e.type", "e.id", "e.lat", F.col("e.lon").alias("lng"), F.coalesce(line, F.array().cast("array<struct<lat: double, lng: double>>")).alias("path"), "e.tags")


def _tag(*names: str, default: str) -> Column:
    return F.coalesce(*[F.nullif(F.element_at("tags", n), F.lit("")) for n in names], F.lit(default))


def roads(elements: DataFrame) -> DataFrame:
    """Lines of two points or more; the category is the kind of highway."""
    return elements.where(F.size("path") >= 2).select(F.concat(F.lit("road-"), F.col("id").cast("string")).alias("id"), _tag("highway", default="road").alias("category"), "path")


def greens(elements: DataFrame, lat0: float, lng0: float, least_m2: float = 20_000.0) -> DataFrame:
    """Closed rings of three points or more and enough area."""
    ends = F.element_at("path", 1) == F.element_at("path", -1)
    closed = elements.where(F.size("path") >= 3).withColumn("ring", F.when(ends, F.col("path")).otherwise(F.concat("path", F.slice("path", 1, 1))))
    named = closed.select(F.concat(F.lit("green-"), F.col("id").cast("string")).alias("id"), _tag("leisure", "landuse", "natural", default="green").alias("category"), "ring")
    return polygons(named, "ring", lat0, lng0).where(F.col("area") >= least_m2)


def industries(elements: DataFrame) -> DataFrame:
    """Points: nodes where they are, lines at the mean of their points."""
    mean = lambda c: F.aggregate("path", F.lit(0.0), lambda a, p: a + p[c]) / F.nullif(F.size("path"), F.lit(0))
    node = F.col("type") == "node"
    out = elements.select(F.concat_ws("-", F.lit("industry"), "type", F.col("id").cast("string")).alias("id"), _tag("landuse", "industrial", "man_made", default="industrial").alias("category"), *[F.when(node, F.col(c)).otherwise(mean(c)).alias(c) for c in ("lat", "lng")])
    return out.dropna(subset=["lat", "lng"])


def sheet_rows(cells: DataFrame) -> DataFrame:
    """(sheet, row, name, value) of a workbook's cells below the header whose first names are device_id and
    calculateddatetime; a header further down takes over from there."""
    heads = cells.groupBy("sheet", "row").agg(F.max(F.when(F.col("column") == "A", F.col("value"))).alias("a"), F.max(F.when(F.col("column") == "B", F.col("value"))).alias("b"))
    known = heads.where("a = 'device_id' and b = 'calculateddatetime'").select("sheet", "row", F.lit(True).alias("header"))
    marked = cells.join(known, ["sheet", "row"], "left")
    above = Window.partitionBy("sheet", "column").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    named = marked.withColumn("name", F.last(F.when(F.col("header"), F.col("value")), True).over(above))
    return named.where(F.col("header").isNull() & F.col("name").isNotNull()).select("sheet", "row", "name", "value")


def json_rows(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """A JSON array of objects; an empty table with the schema where no path is given."""
    return spark.read.schema(schema).json(path, multiLine=True) if path else spark.createDataFrame([], schema)


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """(sheet, row, column, value) of every filled cell of XLSX files, one file a task at a time; a sheet goes by its
    title, or by its part's name where the workbook gives none."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                book, rows = zipfile.ZipFile(io.BytesIO(content)), []
                shared = []
                if "xl/sharedStrings.xml" in book.namelist():
                    shared = ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
                titles = {}
                if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(book.namelist()):
                    parts = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
                    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{main}sheet")
                    titles = {"xl/" + parts[s.get(link)].removeprefix("/xl/"): s.get("name") for s in sheets}
                for name in sorted(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
                    for c in ElementTree.fromstring(book.read(name)).iter(f"{main}c"):
                        v = c.find(f"{main}v")
                        if v is not None and v.text:
                            text = shared[int(v.text)] if c.get("t") == "s" else v.text
                            at = re.fullmatch(r"([A-Z]+)([0-9]+)", c.get("r"))
                            rows.append((titles.get(name, name[14:-4]), int(at[2]), at[1], text))
                yield pd.DataFrame(rows, columns=["sheet", "row", "column", "value"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "sheet string, row long, column string, value string")


def unzipped_series(df: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """One row per position of parallel arrays; shorter ones, and those that lack, give nulls."""
    types = dict(df.dtypes)
    zipped = F.arrays_zip(*[F.coalesce(a, F.array().cast(types[a])).alias(a) for a in arrays])
    return df.select(*keys, F.explode(zipped).alias("z")).select(*keys, *[F.col(f"z.{a}").alias(a) for a in arrays])


# fixed values: a weather archive's fields and what they are called here
ARCHIVE = {
    "temperature_2m_mean": "temperature",
    "relative_humidity_2m_mean": "humidity",
    "precipitation_sum": "precipitation",
    "wind_speed_10m_mean": "wind_speed",
    "wind_direction_10m_dominant": "wind_dir",
    "surface_pressure_mean": "pressure",
}


def meteo_archive(spark: SparkSession, path: str, stations: DataFrame) -> DataFrame:
    """(station, day, ARCHIVE's values) of landed answers of a weather archive, one file a station: stations has (id, file), a
    file's name. A value that lacks is 0, but the pressure null; the wind comes in km/h and goes as m/s."""
    fields = ", ".join(f"{f}: array<double>" for f in ARCHIVE)
    files = spark.read.schema(f"daily struct<time: array<date>, {fields}>").json(path, multiLine=True)
    own = files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "daily.*").join(stations.select(F.col("id").alias("station"), "file"), "file")
    rows = unzipped_series(own, ["station"], ["time", *ARCHIVE]).where("time is not null").withColumnRenamed("time", "day").withColumnsRenamed(ARCHIVE)
    zero = {c: 0.0 for c in ARCHIVE.values() if c != "pressure"}
    return rows.fillna(zero).withColumns({"wind_speed": F.round(F.col("wind_speed") / 3.6, 4), "pressure": F.round("pressure", 2)})


def elevations(spark: SparkSession, path: str, points: DataFrame) -> DataFrame:
    """points (i, ..) with the elevation_m that a landed answer ({"elevation": [..]}) has at their place i."""
    found = spark.read.schema("elevation array<double>").json(path, multiLine=True).select(F.posexplode("elevation").alias("i", "elevation_m"))
    return points.join(found, "i", "left")


def latest_file(spark: SparkSession, folder: str, canonical: str, pattern: str) -> DataFrame:
    """(path, name, modified), one row or none: the file of that name in a folder, else the last by name that fits the pattern."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    found = files.select(F.col("path"), F.element_at(F.split("path", "/"), -1).alias("name"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"))
    return found.orderBy((F.col("name") == canonical).desc(), F.col("name").desc()).limit(1)


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """RFC 4180 quoting, a header, empty fields for nulls; the parts stay as they are dealt."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
