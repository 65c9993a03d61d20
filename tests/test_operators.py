"""Micro-fixtures with known values."""

from datetime import date, datetime

from pyspark.sql import functions as F

from windrow.functions import scalars as S
from windrow.operators import quality, temporal
from windrow.sources import readers
from windrow.streaming.daily import daily_means


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, S.slug(F.lit("Gursu / Hasankoy"))) == "gursu-hasankoy"
    assert one(spark, S.converted(F.lit(0.032), F.lit("mg/m3"), F.lit("PM10"))) == 32.0
    assert one(spark, S.parsed_timestamp(F.lit("15.03.2026 17:00"))) == datetime(2026, 3, 15, 17)
    assert one(spark, S.lenient_double(F.lit("3,5"))) == 3.5
    assert one(spark, S.lenient_double(F.lit("x"))) is None
    assert abs(one(spark, S.normal_cdf(F.lit(1.959964))) - 0.975) < 1e-6


def test_dedupe(spark):
    df = spark.createDataFrame([("a", "PM10", 20.0, "valid", 0), ("a", "PM10", 40.0, "valid", 1), ("b", "PM10", 1.0, "valid", 2)], "s string, p string, value double, quality_flag string, ord int")
    got = {r.s: (r.value, r.quality_flag) for r in quality.deduplicated(df, ["s", "p"], "ord").collect()}
    assert got == {"a": (30.0, "screened"), "b": (1.0, "valid")}


def test_short_series_are_stable(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(3)], "k string, t int, value double")
    assert temporal.mann_kendall(df, ["k"], "t").first().direction == "stable"
    assert temporal.mann_kendall(df.limit(0), ["k"], "t").count() == 0


def test_csv_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿station_id,parameter,value,date,unit\nGursu / X,PM10,"0,032",15.03.2026 17:00,mg/m3\n,PM10,1,2026-01-01,\n', encoding="utf-8")
    got = readers.air_quality(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.station, r.value, r.ts, r.source) for r in got] == [("gursu-x", 32.0, datetime(2026, 3, 15, 17), "a.csv")]


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a", datetime(2024, 1, 1, 5), 2.0), ("a", datetime(2024, 1, 1, 6), 4.0), ("a", datetime(2024, 1, 9), 1.0)], "k string, ts timestamp, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = daily_means(stream, ["k"]).writeStream.format("memory").queryName("daily_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("daily_out").where(F.col("day") == F.lit(date(2024, 1, 1))).collect()
    assert [(r.value, r.n) for r in got] == [(3.0, 2)]
