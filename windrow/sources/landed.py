"""Answers of services that are asked window by window, read from the folder in which they landed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.functions import labels as B
from windrow.functions import scalars as S
from windrow.operators import events as E
from windrow.operators import spatial as X
from windrow.operators.tables import written
from windrow.sources import readers

#: A network is given up after so many requests without an answer.
MOST_FAILURES = 5
# fixed values: names of measurements in the answers, days of a window, sources and messages
OFFICIAL_CODES = ("PM10", "PM25", "NO2", "SO2", "O3")
SENSOR_CODES = ("PM10", "PM25")
SENSOR_DAYS, FIRE_DAYS = 90, 10
OFFICIAL_SOURCE = "Ulusal Hava Kalitesi İzleme Ağı"
SENSOR_ADDED = "Belediye sensör ağından {n} yardımcı istasyon için 2024-01-01 sonrası günlük PM10 ve PM2.5 serisi eklendi."
SENSOR_TIMEOUT = "Belediye sensör ağının tarihsel API'si yavaş yanıt verdiği için yalnızca erişilebilen pencereler pakete eklendi."
OTHER_CONFIDENCE = 60.0


def _range(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.lit(start).cast("date").alias("start_day"), F.lit(end).cast("date").alias("end_day"))


def spans(ranges: DataFrame, days: int) -> DataFrame:
    """(i, start_day, end_day): each range in spans of so many days, one after the other, from 1; the last ends with the range."""
    step = F.expr(f"interval {days} days")
    starts = ranges.where("start_day <= end_day").select(F.col("end_day").alias("last"), F.posexplode(F.sequence("start_day", F.greatest("start_day", "end_day"), step)).alias("i", "start_day"))
    return starts.select((F.col("i") + 1).alias("i"), "start_day", F.least(F.date_add("start_day", days - 1), F.col("last")).alias("end_day"))


def months(ranges: DataFrame) -> DataFrame:
    """The same by calendar months, cut at the range's ends."""
    every = F.sequence(F.trunc("start_day", "month"), F.trunc(F.greatest("start_day", "end_day"), "month"), F.expr("interval 1 month"))
    starts = ranges.where("start_day <= end_day").select(F.col("start_day").alias("first"), F.col("end_day").alias("last"), F.posexplode(every).alias("i", "m"))
    return starts.select((F.col("i") + 1).alias("i"), F.greatest("m", "first").alias("start_day"), F.least(F.last_day("m"), F.col("last")).alias("end_day"))


def day_windows(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    return spans(_range(spark, start, end), days)


def month_windows(spark: SparkSession, start: str, end: str) -> DataFrame:
    return months(_range(spark, start, end))


def answers(spark: SparkSession, folder: str, requests: DataFrame) -> DataFrame:
    """requests, each with a `file`, and the `text` that landed under that name; null where none did.

    Files are read where Spark deals them, one answer a row; names meet requests by a join."""
    files = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("text"))
    return requests.join(files, "file", "left")


def until_broken(asked: DataFrame, order: list[str], most: int = MOST_FAILURES) -> tuple[DataFrame, DataFrame]:
    """(answers, aborted): answers (with `text`) of one network in the order of its requests, up to its `most`-th failure; and one
    row, whether it came to that. What comes after is not used, as if it hadn't been asked for. An answer that is no JSON object is
    a failure. Requests are a few per station; their texts don't take part in the count."""
    broken = F.col("text").isNull() | F.try_parse_json("text").isNull() | ~F.coalesce(F.trim("text").startswith("{"), F.lit(False))
    marked = asked.withColumn("failed", broken)
    at = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = marked.select(*order, "failed").withColumn("failures", F.sum(F.col("failed").cast("int")).over(at)).drop("failed")
    aborted = counted.agg(F.coalesce(F.max("failures") >= most, F.lit(False)).alias("aborted"))
    return marked.join(counted, order).where(~F.col("failed") & (F.col("failures") < most)).drop("failed", "failures"), aborted


def official_requests(spark: SparkSession, start: str, end: str, period: str = "16") -> DataFrame:
    name = F.concat_ws("_", F.lit("aq"), F.lit(period), F.col("start_day").cast("string"), F.concat(F.col("end_day").cast("string"), F.lit(".json")))
    return month_windows(spark, start, end).withColumn("file", name)


def official_records(answered: DataFrame, stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, counts) of an official network's answers: a record for each measurement that is there, its columns turned into
    rows, and of each station and pollutant how many hours were measured and should have been. stations has (source_id, id); rows of
    other stations are left out."""
    data = ", ".join(f"{c}: double" for c in OFFICIAL_CODES)
    schema = f"Object struct<Summaries: array<struct<Parameter: string, Stationid: string, Count: string, MustBeCount: string>>, Data: array<struct<Stationid: string, ReadTime: string, {data}>>>"
    whole = answered.where("text is not null").select(F.from_json("text", schema).alias("j")).select("j.Object.*")
    known = stations.select(F.col("source_id").alias("Stationid"), F.col("id").alias("station"))
    wide = whole.select(F.explode("Data").alias("d")).select("d.*").join(known, "Stationid")
    long = wide.unpivot(["station", "ReadTime"], list(OFFICIAL_CODES), "code", "v").where("v is not null")
    pollutant = B.pollutant_name("code")
    records = long.select("station", F.to_timestamp(B.utc_text("ReadTime")).alias("ts"), pollutant.alias("pollutant"), F.round("v", 4).alias("value"), S.canonical_unit(pollutant).alias("unit"), F.lit("valid").alias("quality_flag"), F.lit(OFFICIAL_SOURCE).alias("source"))
    sums = whole.select(F.explode("Summaries").alias("s")).select("s.*").join(known, "Stationid")
    zero = lambda c: F.sum(F.floor(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)))).cast("long")
    return records, sums.groupBy("station", B.pollutant_name("Parameter").alias("pollutant")).agg(zero("Count").alias("actual"), zero("MustBeCount").alias("expected"))


def sensor_requests(spark: SparkSession, stations: DataFrame, start: str, end: str, first: str = "2024-01-01") -> DataFrame:
    """A request for each station (id, ..) and window of SENSOR_DAYS from the network's first day on."""
    file = F.concat(F.lit("airqoon_"), F.col("station"), F.lit("_"), F.col("start_day").cast("string"), F.lit("_"), F.col("end_day").cast("string"), F.lit(".json"))
    return stations.select(F.col("id").alias("station"), "operator").crossJoin(day_windows(spark, max(start, first), end, SENSOR_DAYS)).withColumn("file", file)


def sensor_records(answered: DataFrame) -> DataFrame:
    """Day means of a sensor network's answers (station, operator, text): numbers of zero and more, all of a day alike."""
    schema = ", ".join(f"{c} array<struct<Value: string, Date: string>>" for c in SENSOR_CODES)
    lists = answered.select("station", "operator", F.from_json("text", schema).alias("j")).select("station", "operator", "j.*")
    each = lists.unpivot(["station", "operator"], list(SENSOR_CODES), "code", "items").select("station", "operator", "code", F.explode("items").alias("item"))
    value = F.col("item.Value").try_cast("double")
    rows = each.select("station", "operator", B.pollutant_name("code").alias("pollutant"), value.alias("v"), F.substring("item.Date", 1, 10).alias("day")).where("v >= 0 and not isnan(v) and day <> ''")
    means = rows.groupBy("station", "operator", "day", "pollutant").agg(F.round(F.avg("v"), 4).alias("value"))
    return means.select("station", F.to_timestamp("day").alias("ts"), "pollutant", "value", F.lit("ug/m3").alias("unit"), F.lit("screened").alias("quality_flag"), F.concat(F.lit("Airqoon / "), "operator").alias("source"))


def sensor_issues(records: DataFrame, aborted: DataFrame) -> DataFrame:
    """(id, severity, message): that stations were added, and that the network was given up."""
    n = records.agg(F.countDistinct("station").alias("n"))
    before, after = SENSOR_ADDED.split("{n}")
    added = n.where("n > 0").select(F.lit("airqoon-network-added").alias("id"), F.lit("info").alias("severity"), F.concat(F.lit(before), F.col("n").cast("string"), F.lit(after)).alias("message"))
    return added.unionByName(aborted.where("aborted").select(F.lit("airqoon-network-timeout").alias("id"), F.lit("warning").alias("severity"), F.lit(SENSOR_TIMEOUT).alias("message")))


def united(*networks: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(stations, records) of several networks, each (stations with id, records): stations come with the pollutants that they
    measure; those of the first network stay without any, those of the others go."""
    stations = records = None
    for i, (own, rows) in enumerate(networks):
        measured = rows.groupBy(F.col("station").alias("id")).agg(F.array_sort(F.collect_set("pollutant")).alias("pollutants"))
        found = own.drop("pollutants").join(measured, "id", "left" if i == 0 else "inner").withColumn("pollutants", F.coalesce("pollutants", F.array().cast("array<string>")))
        stations = found if stations is None else stations.unionByName(found, allowMissingColumns=True)
        records = rows if records is None else records.unionByName(rows)
    return stations, records


def fire_requests(spark: SparkSession, start: str, end: str) -> DataFrame:
    return day_windows(spark, start, end, FIRE_DAYS).withColumn("file", F.format_string("fires_firms_%03d.csv", "i"))


def hotspots(spark: SparkSession, path: str) -> DataFrame:
    """(id, ts, lat, lng, confidence, frp) of CSV files of fire hotspots, ids in order of time and place. A confidence that is no
    number counts as 60; rows without a place or time that can be read are left out."""
    rows = readers.csv(spark, path)
    column = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    number = lambda c: F.trim(column(c)).try_cast("double")
    at = F.try_to_timestamp(F.concat(F.trim(column("acq_date")), F.lit(" "), F.lpad(F.trim(column("acq_time")), 4, "0")), F.lit("yyyy-MM-dd HHmm"))
    plain = F.coalesce(column("confidence"), F.lit("")).rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$")
    power = F.when(F.coalesce(F.trim(column("frp")), F.lit("")) == "", 0.0).otherwise(number("frp"))
    out = rows.select(at.alias("ts"), number("latitude").alias("lat"), number("longitude").alias("lng"), F.when(plain, column("confidence").try_cast("double")).otherwise(OTHER_CONFIDENCE).alias("confidence"), power.alias("frp"))
    good = out.where("ts is not null and lat is not null and lng is not null and frp is not null")
    return good.sort("ts", "lat", "lng").withColumn("id", F.monotonically_increasing_id()).select("id", "ts", "lat", "lng", "confidence", "frp")


def fire_events(clusters: DataFrame) -> DataFrame:
    """Clusters of hotspots as events, numbered in the order in which they began. Numbers are made day by day, and days counted up."""
    by_day = Window.partitionBy("day").orderBy("start", "cluster", "session")
    days = clusters.withColumn("day", F.to_date("start"))
    before = days.groupBy("day").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")  # a row for each day
    i = days.withColumn("n", F.row_number().over(by_day)).join(before, "day").withColumn("i", (F.col("n") + F.col("before")).cast("string"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return i.select(F.concat(F.lit("firms-fire-"), "i").alias("event_id"), F.lit("fire").alias("kind"), F.concat(F.lit("NASA FIRMS yangin kumesi "), "i").alias("name"), iso("start").alias("start"), iso("end").alias("end"), "lat", "lng", "radius_km", F.lit("NASA FIRMS").alias("source"), "confidence", F.col("hotspots").alias("hotspot_count"), F.lit("VIIRS historical hotspot cluster").alias("note"))


def completeness(counts: DataFrame) -> DataFrame:
    """(station, pollutant, actual, expected, ratio): the share of the hours that an official network should have, 4 digits."""
    ratio = F.round(F.coalesce(F.try_divide(F.col("actual").cast("double"), F.nullif("expected", F.lit(0))), F.lit(0.0)), 4)
    return counts.withColumn("ratio", ratio)


EVENT = ("event_id", "kind", "name", "start_day", "end_day", "lat", "lng", "radius_km", "source", "confidence", "hotspot_count")


def network_dataset(spark: SparkSession, root: str, official: DataFrame, sensors: DataFrame, start: str, end: str, curated: DataFrame | None = None) -> dict[str, DataFrame]:
    """A dataset's tables from the folders of a root in which answers landed: official and sensors (measurements), meteo (weather,
    one file a station, named by its id) and fires (hotspots); a folder that isn't there counts as empty.

    official stations have (source_id, id, name, source, lat, lng), sensors (id, operator, name, source, lat, lng), curated events
    EVENT's columns. Fetched fires join them unless they are the same fire. The sensors' network is given up after
    MOST_FAILURES requests without an answer, which `issues` tells."""
    there = lambda name, asked: answers(spark, f"{root}/{name}", asked) if readers.exists(spark, f"{root}/{name}") else asked.withColumn("text", F.lit(None).cast("string"))
    records, counts = official_records(there("official", official_requests(spark, start, end)), official)
    used, aborted = until_broken(there("sensors", sensor_requests(spark, sensors, start, end)), ["station", "start_day"])
    means = written(sensor_records(used), "sensors")
    stations, series = united((official.drop("source_id"), records), (sensors.drop("operator"), means))
    out = {"series": series, "stations": stations, "completeness": completeness(counts), "issues": sensor_issues(means, aborted)}
    if readers.exists(spark, f"{root}/meteo"):
        out["meteo"] = readers.meteo_archive(spark, f"{root}/meteo", stations.select("id", F.concat("id", F.lit(".json")).alias("file")))
    fires = None
    if readers.exists(spark, f"{root}/fires"):
        found = fire_events(X.clusters(written(hotspots(spark, f"{root}/fires"), "hotspots")))
        fires = found.select("event_id", "kind", "name", F.to_date("start").alias("start_day"), F.to_date("end").alias("end_day"), "lat", "lng", "radius_km", "source", "confidence", "hotspot_count")
    if curated is not None and fires is not None:
        out["events"] = E.merged_catalogue(curated.select(*EVENT), fires)
    elif curated is not None or fires is not None:
        out["events"] = (fires if curated is None else curated).select(*EVENT)
    return out
