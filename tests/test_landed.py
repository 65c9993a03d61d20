"""Landed answers of services, layers and packages, from files to tables."""

import datetime
import json
import random

from windrow.sources import dataset, readers


def test_meteo_archive(spark, tmp_path):
    daily = {"time": ["2024-01-01", "2024-01-02"], "temperature_2m_mean": [3.5], "wind_speed_10m_mean": [36.0, None], "surface_pressure_mean": [1013.256, None]}
    (tmp_path / "a.json").write_text(json.dumps({"daily": daily}))
    (tmp_path / "b.json").write_text(json.dumps({"daily": {}}))
    stations = spark.createDataFrame([("s1", "a.json"), ("s2", "b.json")], "id string, file string")
    got = sorted(readers.meteo_archive(spark, str(tmp_path), stations).collect(), key=lambda r: r.day)
    assert [(r.station, str(r.day), r.temperature, r.humidity, r.wind_speed, r.pressure) for r in got] == [("s1", "2024-01-01", 3.5, 0.0, 10.0, 1013.26), ("s1", "2024-01-02", 0.0, 0.0, 0.0, None)]


def test_elevations_and_latest_file(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"elevation": [100.0, 250.5]}))
    points = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "i int, name string")
    assert {r.name: r.elevation_m for r in readers.elevations(spark, str(tmp_path / "e.json"), points).collect()} == {"a": 100.0, "b": 250.5, "c": None}
    for name in ("book-2.xlsx", "book-1.xlsx"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.name for r in readers.latest_file(spark, str(tmp_path), "main.xlsx", "*.xlsx").collect()] == ["book-2.xlsx"]
    (tmp_path / "main.xlsx").write_bytes(b"x")
    found = readers.latest_file(spark, str(tmp_path), "book-1.xlsx", "*.xlsx").collect()
    assert [r.name for r in found] == ["book-1.xlsx"] and found[0].modified.endswith("Z")


def test_legacy_and_layers(spark, tmp_path):
    (tmp_path / "all.json").write_text(json.dumps({"stations": [{"id": "a"}, {"id": "b"}], "roads": [{"id": "r"}]}))
    tables = dataset.legacy(spark, str(tmp_path / "all.json"), ("stations", "roads", "events"))
    assert set(tables) == {"stations", "roads"} and tables["stations"].count() == 2
    dataset.write({"roads": tables["roads"], "greens": tables["stations"]}, str(tmp_path / "out"), "v1")
    layers = dataset.read_layers(spark, str(tmp_path / "out"), {"greens", "elevations"})
    assert set(layers) == {"greens"} and dataset.read_layers(spark, str(tmp_path / "out"), set()) == {}
    merged = dataset.with_layers(tables, layers | {"stations": tables["roads"]})
    assert merged["greens"].count() == 2 and merged["stations"].count() == 2


def test_packages(spark, tmp_path):
    r, day = random.Random(3), datetime.date(2024, 3, 1)
    daily = spark.createDataFrame([(s, p, day + datetime.timedelta(days=i), r.random() * 40) for s in range(8) for p in ("PM10", "NO2") for i in range(31)], "station long, pollutant string, day date, value double")
    stations = [(s, 40 + r.random(), 29 + r.random(), "all") for s in range(8)]
    stations += [(s, lat, lng, "physical") for s, lat, lng, _ in stations[:4]]
    slices = spark.createDataFrame([("month-2024-03", "month", day, datetime.date(2024, 3, 31)), ("event-1", "event", day, day), ("month-2024-04", "month", datetime.date(2024, 4, 1), datetime.date(2024, 4, 30))], "slice_id string, kind string, start_day date, end_day date")
    dataset.build_packages(daily, spark.createDataFrame(stations, "id long, lat double, lng double, scope string"), slices, str(tmp_path))
    manifest, rows = dataset.read_packages(spark, str(tmp_path), "PM10")
    got = {(x.scope, x.slice_id): x for x in rows.collect()}
    assert set(got) == {(s, k) for s in ("physical", "all") for k in ("month-2024-03", "event-1")}
    assert got["all", "month-2024-03"].status == "ok" and got["all", "month-2024-03"].moran_i is not None
    assert got["physical", "event-1"].status == "insufficient-observations" and got["physical", "event-1"].moran_i is None
    assert {(m.scope, m.months, m.usable_months, m.events) for m in manifest.collect()} == {("all", 1, 1, 1), ("physical", 1, 0, 1)}


def test_json_rows_and_csv(spark, tmp_path):
    (tmp_path / "rows.json").write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2}]))
    assert [(r.a, r.b) for r in readers.json_rows(spark, str(tmp_path / "rows.json"), "a long, b string").collect()] == [(1, "x"), (2, None)]
    assert readers.json_rows(spark, None, "a long, b string").count() == 0
    readers.write_csv(spark.createDataFrame([(1, 'say "no", twice'), (2, None)], "a long, b string").coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert text == 'a,b\n1,"say ""no"", twice"\n2,\n'
