"""The explorer's tables, first-met identity, and cards with known values."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from windrow.operators import explorer, layers, quality, results
from windrow.operators.results import Filters
from windrow.sources import networks, readers

RECORDS = "station string, pollutant string, ts timestamp, day date, value double, source string"


@pytest.fixture(scope="module")
def tables(spark):
    rows = []
    for y in range(2019, 2024):
        for d in range(0, 360, 3):
            ts = datetime(y, 1, 1) + timedelta(days=d)
            rows += [("a", "PM10", ts, ts.date(), 20.0 + y - 2019 + ts.month, "official"), ("b", "PM10", ts, ts.date(), 50.0 + (d % 7), "municipal")]
    stations = [("a", "Alpha", "official", ["PM10"], 40.0, 29.0), ("b", "Beta", "municipal", ["PM10", "NO2"], 40.2, 29.1), ("c", "Gamma", "official", ["PM10"], 40.4, 29.2), ("d", "Delta", "official", ["NO2"], 40.4, 29.2)]
    meteo = [(s, date(2023, 6, 1) + timedelta(days=i), 10.0 + i, 50.0, 2.0, float((350 + 20 * i) % 360), None if i else 1000.0, 0.5) for s in ("a", "b") for i in range(3)]
    contexts = [(s, r, x, 2 * x, 1 - x, x, int(10 * x), 100.0, x) for s, x in (("a", 0.1), ("b", 0.4), ("c", 0.9)) for r in (250, 500)]
    events = [(1, "fire", date(2023, 6, 1), date(2023, 6, 2), 40.1, 29.0, 20.0), (2, "dust", date(2020, 1, 1), date(2020, 1, 2), 40.1, 29.0, 20.0)]
    areas = [(1, "One", ["a"], 0.5), (2, "Two", ["b", "c"], None), (3, "Three", ["d"], 0.9)]
    frame = spark.createDataFrame
    return {
        "records": frame(rows, RECORDS),
        "stations": frame(stations, "id string, name string, source string, pollutants array<string>, lat double, lng double"),
        "meteo": frame(meteo, "station string, day date, temperature double, humidity double, wind_speed double, wind_dir double, pressure double, precipitation double"),
        "contexts": frame(contexts, "station string, radius int, building_density double, road_density double, green_ratio double, impervious_ratio double, industry_count int, mean_elevation double, slope_mean double"),
        "events": frame(events, "event_id int, kind string, start_day date, end_day date, lat double, lng double, radius_km double"),
        "neighborhoods": frame(areas, "area int, name string, stations array<string>, road_density double"),
    }


def test_analysis_of_a_dataset(tables):
    f = Filters("PM10", start="2023-01-01", end="2023-06-10")
    found = explorer.analyze_dataset(tables, f, 50.0)
    shots = {r.station: r for r in found["snapshots"].collect()}
    assert set(shots) == {"a", "b", "c"} and (shots["c"].current, shots["c"].anomaly, shots["c"].mean) == (0.0, 0.0, 0.0)
    last = [r.value for r in tables["records"].where("station = 'a' and day between '2023-01-01' and '2023-06-10'").orderBy("day").collect()]
    assert shots["a"].current == pytest.approx(sum(last[-16:]) / 16) and shots["a"].mean == pytest.approx(sum(last) / len(last))
    # June of 2023 is the highest of the five Junes 26, 27, 28, 29, 30
    assert shots["a"].anomaly == pytest.approx(2 / 2.5**0.5)
    r = {x.metric: x for x in found["correlations"].collect()}
    assert len(r) == 7 and r["road_density"].r == pytest.approx(1) and r["green_ratio"].r == pytest.approx(-1) and r["mean_elevation"].r == 0 and {x.n for x in r.values()} == {2}
    bins = [(x.direction, x.wind) for x in found["rose"].collect()]
    assert len(bins) == 8 and sum(w > 0 for _, w in bins) >= 1
    assert found["event"].first().event_id == 1 and {x.station for x in found["event_impact"].collect()} == {"a", "b", "c"}
    assert {x.station for x in found["selected_contexts"].collect()} == {"a", "b", "c"}
    row = found["export"].orderBy("key").first()
    assert (row.resolution, row.station_selection, row.start_date, row.end_date) == ("aylık", results.ALL_STATIONS, "2023-01-01", "2023-06-10")
    own = explorer.analyze_dataset(tables, Filters("PM10", scope="municipal", station="b"), 50.0)
    assert {x.station for x in own["snapshots"].collect()} == {"b"} and own["event"].count() == 1
    row = results.series_rows(own["series"], Filters("PM10", station="b"), tables["records"], tables["stations"]).first()
    assert (row.station_selection, row.start_date, row.end_date) == ("Beta", "2019-01-01", "2023-12-24")


def test_views_and_pages(tables):
    f = Filters("PM10", start="2023-01-01", end="2023-06-10")
    shown = explorer.views(tables, explorer.analyze_dataset(tables, f, 50.0), f)
    assert set(shown) == set(explorer.PAGES)
    rows = lambda name, n, size=2: explorer.page(shown[name], n, size).collect()
    assert [r.station for r in rows("stations", 1)] == ["b", "a"] and [r.station for r in rows("stations", 2)] == ["c"] and rows("stations", 3) == []
    assert [str(r.day) for r in rows("meteo", 1)] == ["2023-06-03", "2023-06-02"]
    day = rows("meteo", 2)[0]
    assert (day.temperature, day.pressure, day.precipitation, day.wind_dir) == (10.0, 1000.0, 1.0, pytest.approx(350.0))
    assert [r.name for r in rows("neighborhoods", 1, 3)] == ["Two", "Three", "One"]
    assert [r.event_id for r in rows("events", 1)] == [1] and [r.station_name for r in rows("contexts", 1)] == ["Alpha", "Beta"]
    assert len(rows("series", 1, 12)) == 6
    assert len(explorer.comparison(tables["records"], f, "same-month").collect()) == 1 and explorer.comparison(tables["records"], Filters("PM10"), "same-month").count() == 5
    assert explorer.comparison(tables["records"], Filters("PM10"), "season-over-season").count() == 12 and explorer.comparison(tables["records"], Filters("PM10")).count() == 18


def test_first_met_by_place(spark, tmp_path):
    (tmp_path / "1.csv").write_text("id,name\nx,zeta\ny,eta\nx,alpha\n")
    (tmp_path / "2.csv").write_text("id,name\ny,alpha\nz,one\n")
    rows = spark.read.csv(str(tmp_path), header=True).select("id", "name", readers.place().alias("place")).repartition(4)
    assert {r.id: r.name for r in quality.first_met(rows, ["id"]).collect()} == {"x": "zeta", "y": "eta", "z": "one"}
    a, b = (spark.read.csv(str(tmp_path / f"{i}.csv"), header=True).select("name", readers.place().alias("place")) for i in (1, 2))
    got = results.referenced([b, a], "name").collect()
    assert sorted(r.slug for r in got) == ["alpha", "alpha-2", "eta", "one", "zeta"]


def test_areas_with_one_id_by_place(spark, tmp_path):
    ring = lambda x: [[[29 + x, 40], [29.02 + x, 40], [29.02 + x, 40.02], [29 + x, 40.02], [29 + x, 40]]]
    features = [{"type": "Feature", "properties": {"name": n}, "geometry": {"type": "Polygon", "coordinates": ring(x)}} for n, x in (("z", 0.0), ("a", 0.5))]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    areas = networks.polygons(spark, str(tmp_path / "a.geojson")).select(F.lit("same").alias("area"), F.col("properties")["name"].alias("name"), "ring", "place")
    stations = spark.createDataFrame([("s", "D", 40.01, 29.01)], "id string, district string, lat double, lng double")
    contexts = spark.createDataFrame([("s", 0.5)], "station string, road_density double")
    (got,) = networks.neighbourhoods(areas, stations, contexts, 40.0, 29.0).collect()
    assert (got.name, got.stations, got.road_density, got.district) == ("z", ["s"], 0.5, "D")
    (other,) = networks.neighbourhoods(areas.drop("place"), stations, contexts, 40.0, 29.0).collect()
    assert other.name == "a"


def test_diagnostics_of_a_rising_series(spark):
    rows = [("a", "PM10", date(y, m, 1), float(10 * (y - 2018) + m), None) for y in range(2019, 2024) for m in range(1, 13)]
    found = results.analyze(spark.createDataFrame(rows, "station string, pollutant string, day date, value double, source string"), Filters("PM10"), 45.0)
    got = {r.id: (r.value, r.tone) for r in found["diagnostics"].collect()}
    assert got["seasonal-kendall"] == ("+10,00 µg/m3/yıl", "warning")
    # of 60 days, one each month, those over 45 are 1 in 2021 to 12 in 2023, and months are no neighbours of each other
    over = sum(10 * (y - 2018) + m > 45 for y in range(2019, 2024) for m in range(1, 13))
    assert got["exceedance-episodes"] == (f"{over} epizot", "accent")
    assert got["cusum-break"][1] in ("warning", "cool", "neutral") and got["kz-decomposition"][0].startswith("%")


def test_surroundings_without_features_or_heights(spark):
    stations = spark.createDataFrame([(1, 40.0, 29.0)], "id long, lat double, lng double")
    none = spark.createDataFrame([], "kind string, lat double, lng double, area double, length double")
    heights = spark.createDataFrame([(1, 500, 0, 100.0), (1, 500, 1, 135.0)], "id long, radius int, sample int, elevation double")
    got = layers.station_buffers(stations, none, heights).orderBy("radius").collect()
    assert [(r.radius, r.building_density, r.industry_count, r.mean_elevation, r.slope_mean) for r in got] == [(250, 0.0, 0, None, None), (500, 0.0, 0, 117.5, 5.71), (1000, 0.0, 0, None, None)]
    at = [("industry", 40.0, 29.0, None, None), ("industry", 40.004, 29.0, 400.0, None), ("road", 40.0, 29.001, 100.0, 50.0)]
    got = layers.station_buffers(stations, spark.createDataFrame(at, "kind string, lat double, lng double, area double, length double"), heights).orderBy("radius").collect()
    assert [r.industry_count for r in got] == [1, 2, 2] and got[0].road_density == pytest.approx(0.05 / (3.14159 * 0.0625), abs=1e-3)
