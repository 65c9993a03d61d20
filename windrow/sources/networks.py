"""Landed files of station networks as records, stations, areas and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions import geo as G
from windrow.functions import scalars as S
from windrow.operators import layers as Y
from windrow.operators import nearby as N
from windrow.operators.quality import mean_of_means

# fixed values: arrays of a modelled series and what they measure
MODELLED = {"pm10": "PM10", "pm2_5": "PM2.5", "nitrogen_dioxide": "NO2", "sulphur_dioxide": "SO2", "ozone": "O3"}
HOURLY = "station string, hourly struct<time: array<string>, " + ", ".join(f"{c}: array<double>" for c in MODELLED) + ">"


def backfill(series: DataFrame) -> DataFrame:
    """Day means of modelled hourly series (station, hourly: parallel arrays), flagged as estimated; hours without a value
    are left out, and arrays may be of different lengths or missing."""

    def measured(array: str, name: str) -> Column:
        zipped = F.arrays_zip(F.col("hourly.time").alias("t"), F.col(f"hourly.{array}").alias("v"))
        return F.transform(zipped, lambda z: F.struct(F.lit(name).alias("pollutant"), z["t"].alias("t"), z["v"].alias("v")))

    each = [measured(*item) for item in MODELLED.items()]
    none = F.array().cast("array<struct<pollutant: string, t: string, v: double>>")
    long = series.select("station", F.explode(F.concat(*[F.coalesce(e, none) for e in each])).alias("z")).select("station", "z.*").where("v is not null and t is not null")
    days = long.groupBy(F.concat(F.lit("modeled-"), "station").alias("station"), "pollutant", F.to_date(F.substring("t", 1, 10)).alias("day"))
    return days.agg(F.round(F.avg("v") + 1e-9, 4).alias("value")).select("*", F.lit("ug/m3").alias("unit"), F.lit("estimated").alias("quality_flag"))


def official_sheets(rows: DataFrame, places: DataFrame, pollutants: dict[str, str], start: str, end: str) -> dict[str, DataFrame]:
    """records, stations and issues of a network's workbook.

    rows (sheet, row, name, value) are the sheets' cells, places (sheet, id, ...) says which station a sheet is, pollutants
    gives the columns that are measurements. The last 365 days of the range count; missing and negative values go; hours
    are averaged first, then days. Sheets without a place or without a usable value are issues, not stations."""
    wide = rows.groupBy("sheet", "row").pivot("name", ["device_id", "calculateddatetime", *pollutants]).agg(F.first("value"))
    held = wide.join(places, "sheet", "left")
    day = F.to_date("ts")
    first = F.greatest(F.to_date(F.lit(start)), F.date_sub(F.to_date(F.lit(end)), 365))
    cells = F.explode(F.array(*[F.struct(F.lit(p).alias("pollutant"), S.lenient_double(F.col(f"`{c}`")).alias("value")) for c, p in pollutants.items()]))
    timed = held.where("id is not null").withColumn("ts", S.excel_time(S.lenient_double("calculateddatetime")))
    long = timed.where(day.between(first, F.to_date(F.lit(end)))).select("id", "ts", cells.alias("z")).select("id", "ts", "z.*").where("value >= 0")
    means = mean_of_means(long.withColumn("ts", F.date_trunc("second", "ts")), ["id", "pollutant"])
    found = means.groupBy("id").agg(F.array_sort(F.collect_set("pollutant")).alias("pollutants"))
    devices = held.groupBy("id").agg(F.nullif(F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim("device_id"), F.lit("")))), ","), F.lit("")).alias("devices"))
    stations = places.drop("sheet").join(found, "id").join(devices, "id", "left").withColumn("devices", F.coalesce("devices", "id"))
    sheets = wide.select("sheet").distinct().join(places.select("sheet", "id"), "sheet", "left").join(found, "id", "left")
    kind = F.when(F.col("id").isNull(), F.lit("location-missing")).otherwise("empty")
    issues = sheets.where("pollutants is null").select(kind.alias("kind"), F.coalesce("id", "sheet").alias("subject"), F.lit("warning").alias("severity"))
    return {"records": means, "stations": stations, "issues": issues}


def sensors(devices: DataFrame, extent: tuple[float, float, float, float], name: Column) -> DataFrame:
    """Devices inside south, west, north, east, borders included, under a name made uniform."""
    south, west, north, east = extent
    return devices.where(F.col("lat").between(south, north) & F.col("lng").between(west, east)).withColumn("name", name)


FEATURES = "features array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>, type string, geometry struct<type: string, coordinates: string>, coordinates string"


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """(feature, part, ring, holes, properties, place) of the polygons in GeoJSON files, whether they hold a bare geometry, one
    feature or many; rings are arrays of structs (x = lng, y = lat), and place orders them as the files do."""
    raw = spark.read.schema(FEATURES).json(path, multiLine=True)
    empty = F.create_map().cast("map<string, string>")
    own = F.struct(F.coalesce("geometry", F.struct("type", "coordinates")).alias("geometry"), empty.alias("properties"))
    f = raw.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.coalesce("features", F.array(own))).alias("feature", "f")).select("file", "feature", "f.geometry.*", "f.properties")
    one = F.array(F.from_json("coordinates", "array<array<array<double>>>"))
    parts = F.when(F.col("type") == "Polygon", one).when(F.col("type") == "MultiPolygon", F.from_json("coordinates", "array<array<array<array<double>>>>"))
    rings = f.select("file", "feature", "properties", F.posexplode(parts).alias("part", "rings"))
    shaped = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return rings.withColumn("r", shaped).where(F.size("r") > 0).select("feature", "part", F.element_at("r", 1).alias("ring"), F.slice("r", 2, F.size("r")).alias("holes"), "properties", F.struct("file", "feature", "part").alias("place"))


def inside(lng, lat, ring="ring", holes="holes") -> Column:
    """In a polygon and in none of its holes."""
    return G.in_ring(lng, lat, ring) & ~F.exists(holes, lambda h: G.in_ring(lng, lat, h))


CONTEXT = ("building_density", "road_density", "green_ratio", "impervious_ratio", "mean_elevation", "slope_mean", "industry_count")


def neighbourhoods(areas: DataFrame, stations: DataFrame, contexts: DataFrame, lat0: float, lng0: float, least_m2: float = 150_000.0) -> DataFrame:
    """Areas (area, name, ring) that are large enough, with their stations (id, district, lat, lng) and mean surroundings.

    Surroundings are those of the stations inside, or of the three nearest where none inside has any; contexts has one row
    a station. Of areas with one id the first in the input counts, by their `place` if they have one, else the first by name."""
    flat = F.transform("ring", lambda p: F.struct(*[v.alias(k) for v, k in zip(G.projected(p["y"], p["x"], lat0, lng0), "xy", strict=True)]))
    cx, cy = G.ring_centroid(F.col("flat"))
    first = F.min_by(F.struct("name", "ring"), "place") if "place" in areas.columns else F.min(F.struct("name", "ring"))
    sized = areas.groupBy("area").agg(first.alias("a")).select("area", "a.*").where(F.size("ring") >= 3).withColumn("flat", flat)
    sized = sized.withColumns({"area_m2": G.ring_area(F.col("flat")), "cx": cx, "cy": cy}).where(F.col("area_m2") >= least_m2)
    measured = stations.join(contexts.withColumnRenamed("station", "id").withColumn("known", F.lit(True)), "id", "left")
    sx, sy = G.projected("lat", "lng", lat0, lng0)
    centres = sized.select("area", F.col("cx").alias("x"), F.col("cy").alias("y"))
    placed = stations.select("id", sx.alias("sx"), sy.alias("sy")).withColumns({"x": F.col("sx"), "y": F.col("sy")})
    near = N.candidates(centres, placed, "area", ["x", "y"], 3).select("area", "id", F.hypot(F.col("sx") - F.col("x"), F.col("sy") - F.col("y")).alias("far"))
    near = near.selectExpr("area", "id", "row_number() over (partition by area order by far, id) as place").where("place <= 3")
    pairs = Y.inside(sized, stations).withColumn("member", F.lit(True)).join(near, ["area", "id"], "full").withColumn("member", F.coalesce("member", F.lit(False))).join(measured, "id").join(sized, "area")
    ranked = pairs.selectExpr("*", "max(member and known) over (partition by area) as own")
    used = F.when(F.coalesce("own", F.lit(False)), F.col("member")).otherwise(F.col("place") <= 3)
    there = [c for c in CONTEXT if c in contexts.columns]
    means = [F.round(F.avg(F.when(used, F.col(c))), 4).alias(c) for c in there]
    members = F.array_sort(F.collect_list(F.when(F.col("member"), F.col("id")))).alias("stations")
    district = F.min_by("district", F.when(F.col("member") & F.col("district").isNotNull(), F.col("id"))).alias("district")
    return ranked.groupBy("area", "name").agg(F.round(F.first("area_m2") / 1e6, 4).alias("km2"), members, district, *means)


def elevation_cells(extents: DataFrame, n: int = 6) -> DataFrame:
    """n x n cells of an extent (one row: south, west, north, east), row by row, each with its centre and its closed ring (x = lng,
    y = lat)."""
    cells = extents.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n * n - 1).cast("long"))).alias("cell"))
    dy, dx = (F.col("north") - F.col("south")) / n, (F.col("east") - F.col("west")) / n
    i, j = F.floor(F.col("cell") / n), F.col("cell") % n
    corner = lambda a, b: F.struct((F.col("west") + (j + b) * dx).alias("x"), (F.col("south") + (i + a) * dy).alias("y"))
    ring = F.array(corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0), corner(0, 0))
    return cells.select("cell", (F.col("south") + (i + 0.5) * dy).alias("lat"), (F.col("west") + (j + 0.5) * dx).alias("lng"), ring.alias("ring"))


def elevation_grid(spark: SparkSession, south: float, west: float, north: float, east: float, n: int = 6) -> DataFrame:
    sides = {"south": south, "west": west, "north": north, "east": east}
    return elevation_cells(spark.range(1).select(*[F.lit(v).alias(k) for k, v in sides.items()]), n)
