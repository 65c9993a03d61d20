"""Filters, labels, layers and merges with known values, and empty inputs."""

from datetime import date

from pyspark.sql import functions as F

from windrow.functions import labels as L
from windrow.operators import layers, results
from windrow.operators.results import Filters

RECORDS = "station string, pollutant string, day date, value double, source string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_labels(spark):
    assert one(spark, L.district(F.lit("Bursa - Gürsu (Merkez)"))) == "Gürsu"
    assert one(spark, L.district(F.lit("Bursa-MTHM"))) == "MTHM"
    assert one(spark, L.district(F.lit("Bursa"))) == "Nilüfer"
    assert one(spark, L.sensor_name(F.lit("Park - 3"), F.lit("T"))) == "Park"
    assert one(spark, L.sensor_name(F.lit("Park"), F.lit(None).cast("string"))) == "Park"
    assert one(spark, L.station_type(F.lit(None).cast("int"), F.lit(2000))) == "rural"
    assert one(spark, L.source_badge(F.lit(None).cast("string"))) == "Resmî"
    assert one(spark, L.percent(F.lit(0.254))) == "%25" and one(spark, L.signed(F.lit(1234.5))) == "+1.234,5"
    assert one(spark, L.percent(F.lit(None).cast("double"))) == "Veri yok"
    assert one(spark, L.years_back(F.lit("2024-02-29").cast("date"), 1)) == date(2023, 2, 28)
    assert one(spark, L.string_hash(F.lit("abc"))) == 96354
    assert one(spark, L.surface_method(F.lit("kriging"), F.array(F.lit("idw")))) == "idw"
    assert one(spark, L.surface_method(F.lit("kriging"), F.array().cast("array<string>"))) == "idw"


def test_filters(spark):
    f = Filters("PM10", station="x", start="2024-03-01", end="2024-02-01").normalised({"a"})
    assert (f.start, f.end, f.station) == ("2024-02-01", "2024-03-01", "all")
    assert Filters("PM10").for_event(3, "2024-01-10", "2024-01-12").end == "2024-01-26"
    rows = [("a", "PM10", date(2024, 1, 1), 1.0, None), ("b", "PM10", date(2024, 1, 2), 2.0, "modeled"), ("a", "NO2", date(2024, 1, 1), 3.0, None)]
    df = spark.createDataFrame(rows, RECORDS)
    assert [r.value for r in df.where(Filters("PM10", scope="official").predicate()).collect()] == [1.0]
    assert df.where(Filters("PM10", start="2024-01-02").predicate()).count() == 1


def test_analysis_of_nothing(spark):
    found = results.analyze(spark.createDataFrame([], RECORDS), Filters("PM10"), 50.0)
    assert all(df.count() == 0 for df in found.values())


def test_analysis(spark):
    rows = [("a", "PM10", date(y, m, 1), float(10 * y + m), None) for y in range(2019, 2024) for m in range(1, 13)]
    found = results.analyze(spark.createDataFrame(rows, RECORDS), Filters("PM10"), 50.0)
    assert found["trend"].first().direction == "increasing" and found["series"].count() == 60
    assert {r.id for r in found["diagnostics"].collect()} >= {"seasonal-kendall", "exceedance-episodes", "kz-decomposition"}
    assert found["cards"].first().exceedance_days == 60


def test_segments_and_lengths(spark):
    path = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lng")) for a, b in ((0.0, 0.0), (0.0, 1.0), (1.0, 1.0))])
    lines = spark.range(1).select("id", F.lit("primary").alias("category"), path.alias("path"))
    assert [round(r.metres) for r in layers.segments(lines).orderBy("i").collect()] == [111195, 111195]
    assert round(lines.select(layers.line_length("path").alias("x")).first().x) == 222390


def test_contexts_without_features(spark):
    cells = spark.createDataFrame([("r000c000", 40.0, 29.0)], "cell_id string, lat double, lng double")
    none = lambda more: spark.createDataFrame([], f"lat double, lng double, {more} double")
    roads = spark.createDataFrame([], "category string, lat1 double, lng1 double, lat2 double, lng2 double")
    got = layers.cell_contexts(cells, roads, none("x"), none("area"), none("height"), (40.0, 29.0)).first()
    assert got.nearest_road_m is None and got.proximity_index == 0 and got.industry_count == 0


def test_merged_wind_is_a_direction(spark):
    s = spark.createDataFrame([("roadDensity", date(2024, 1, 1), date(2024, 1, 31), 0.2, 10, 350.0), ("roadDensity", date(2024, 2, 1), date(2024, 3, 2), 0.4, 10, 10.0)], "driver string, start_day date, end_day date, coefficient double, n int, wind double")
    got = results.merged_drivers(s, ["driver"], "2024-01-01", "2024-12-31").first()
    assert abs((got.wind + 180) % 360 - 180) < 1e-6 and got.n == 20 and abs(got.coefficient - 0.3) < 1e-9
