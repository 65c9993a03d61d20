"""Answers that landed window by window; fire hotspots from CSV to events; components."""

import datetime
import json
import random

from pyspark.sql import functions as F

from windrow.operators import components, spatial
from windrow.sources import curated, landed


def days(df):
    return [(r.i, str(r.start_day), str(r.end_day)) for r in df.orderBy("i").collect()]


def test_windows(spark):
    assert days(landed.month_windows(spark, "2024-01-15", "2024-03-02")) == [(1, "2024-01-15", "2024-01-31"), (2, "2024-02-01", "2024-02-29"), (3, "2024-03-01", "2024-03-02")]
    assert days(landed.day_windows(spark, "2024-01-01", "2024-01-25", 10)) == [(1, "2024-01-01", "2024-01-10"), (2, "2024-01-11", "2024-01-20"), (3, "2024-01-21", "2024-01-25")]
    assert days(landed.day_windows(spark, "2024-02-01", "2024-01-25", 10)) == days(landed.month_windows(spark, "2024-02-01", "2024-01-25")) == []


def test_official_network(spark, tmp_path):
    own = {"Object": {"Summaries": [{"Parameter": "PM25", "Stationid": "x", "Count": 20, "MustBeCount": "24.0"}, {"Parameter": "PM25", "Stationid": "?", "Count": 9, "MustBeCount": 9}], "Data": [{"Stationid": "x", "ReadTime": "2024-01-15T05:00:00", "PM10": 12.34567, "PM25": None, "O3": 0}, {"Stationid": "?", "ReadTime": "2024-01-15T05:00:00", "PM10": 1}]}}
    (tmp_path / "aq_16_2024-01-15_2024-01-31.json").write_text(json.dumps(own))
    (tmp_path / "aq_16_2024-02-01_2024-02-03.json").write_text(json.dumps({"Object": {"Summaries": [{"Parameter": "PM25", "Stationid": "x", "Count": 1, "MustBeCount": 24}], "Data": None}}))
    stations = spark.createDataFrame([("x", "hill")], "source_id string, id string")
    asked = landed.answers(spark, str(tmp_path), landed.official_requests(spark, "2024-01-15", "2024-02-03"))
    assert asked.count() == 2
    records, counts = landed.official_records(asked, stations)
    assert sorted((r.station, str(r.ts), r.pollutant, r.value, r.unit) for r in records.collect()) == [("hill", "2024-01-15 05:00:00", "O3", 0.0, "ug/m3"), ("hill", "2024-01-15 05:00:00", "PM10", 12.3457, "ug/m3")]
    assert [tuple(r) for r in counts.collect()] == [("hill", "PM2.5", 21, 48)]


def test_sensor_network_with_gaps_and_union(spark, tmp_path):
    stations = spark.createDataFrame([("s1", "City", 40.0), ("s2", "City", 41.0)], "id string, operator string, lat double")
    requests = landed.sensor_requests(spark, stations, "2020-01-01", "2024-09-01")
    names = sorted(r.file for r in requests.collect())
    assert len(names) == 6 and names[0] == "airqoon_s1_2024-01-01_2024-03-30.json"
    (tmp_path / names[0]).write_text(json.dumps({"PM10": [{"Value": 4, "Date": "2024-01-01T01:00"}, {"Value": "8.0", "Date": "2024-01-01T02:00"}, {"Value": -1, "Date": "2024-01-01"}, {"Value": "x", "Date": "2024-01-02"}, {"Value": 5}, {"Value": 7, "Date": "2024-01-03"}], "PM25": None, "NO2": [{"Value": 1, "Date": "2024-01-01"}]}))
    (tmp_path / names[1]).write_text("<html>")
    asked = landed.answers(spark, str(tmp_path), requests)
    used, aborted = landed.until_broken(asked, ["station", "start_day"])
    assert [r.file for r in used.collect()] == names[:1] and aborted.first().aborted
    records = landed.sensor_records(used)
    assert sorted((r.station, str(r.ts)[:10], r.pollutant, r.value, r.source) for r in records.collect()) == [("s1", "2024-01-01", "PM10", 6.0, "Airqoon / City"), ("s1", "2024-01-03", "PM10", 7.0, "Airqoon / City")]
    assert sorted(r.id for r in landed.sensor_issues(records, aborted).collect()) == ["airqoon-network-added", "airqoon-network-timeout"]
    official = spark.createDataFrame([("o1", 40.5), ("o2", 40.6)], "id string, lat double")
    measured = spark.createDataFrame([("o1", datetime.datetime(2024, 1, 1), "NO2", 3.0, "ug/m3", "valid", "net")], "station string, ts timestamp, pollutant string, value double, unit string, quality_flag string, source string")
    stations, rows = landed.united((official, measured), (stations, records))
    assert {r.id: r.pollutants for r in stations.collect()} == {"o1": ["NO2"], "o2": [], "s1": ["PM10"]} and rows.count() == 3


def test_failures_short_of_the_limit_lose_their_own_window_alone(spark):
    rows = [(i, None if i in (1, 3, 4, 5) else "{}") for i in range(8)]
    used, aborted = landed.until_broken(spark.createDataFrame(rows, "i int, text string"), ["i"])
    assert sorted(r.i for r in used.collect()) == [0, 2, 6, 7] and not aborted.first().aborted
    used, aborted = landed.until_broken(spark.createDataFrame(rows, "i int, text string"), ["i"], most=3)
    assert sorted(r.i for r in used.collect()) == [0, 2] and aborted.first().aborted


def test_fire_hotspots_to_events(spark, tmp_path):
    text = "latitude,longitude,acq_date,acq_time,confidence,frp\n40.0,29.0,2024-07-01,130,90,1.5\n40.01,29.0,2024-07-02,0130,n,\n41.9,29.0,2024-07-01,2359,50,3\nx,29,2024-07-01,100,1,1\n40,29,2024-13-01,100,1,1\n40,29,2024-07-01,100,1,many\n"
    (tmp_path / "fires_firms_001.csv").write_text(text)
    spots = landed.hotspots(spark, str(tmp_path))
    assert [(str(r.ts), r.lat, r.confidence, r.frp) for r in spots.orderBy("id").collect()] == [("2024-07-01 01:30:00", 40.0, 90.0, 1.5), ("2024-07-01 23:59:00", 41.9, 50.0, 3.0), ("2024-07-02 01:30:00", 40.01, 60.0, 0.0)]
    events = landed.fire_events(spatial.clusters(spots)).orderBy("event_id").collect()
    assert [(e.event_id, e.start, e.end, e.hotspot_count, e.radius_km, e.confidence) for e in events] == [("firms-fire-1", "2024-07-01T01:30:00Z", "2024-07-02T01:30:00Z", 2, 2.0, 0.75), ("firms-fire-2", "2024-07-01T23:59:00Z", "2024-07-01T23:59:00Z", 1, 2.0, 0.5)]
    assert [r.file for r in landed.fire_requests(spark, "2024-07-01", "2024-07-15").orderBy("i").collect()] == ["fires_firms_001.csv", "fires_firms_002.csv"]
    assert landed.fire_events(spatial.clusters(spots.limit(0))).count() == 0


def test_components(spark):
    r = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(300, 300), (5, 4)]
    label = {n: n for pair in links for n in pair}
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.node: x.component for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in label.items() if any(n in p and p[0] != p[1] for p in links)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_hold_clusters_together(spark):
    """Fires of every day in two places: one session, but each place is worked on by itself."""
    rows = [(2 * i + k, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i), 40.0 + 3 * k, 29.0, 50.0) for i in range(30) for k in (0, 1)]
    got = spatial.clusters(spark.createDataFrame(rows, "id long, ts timestamp, lat double, lng double, confidence double")).collect()
    assert sorted((g.session, g.cluster, g.hotspots, g.lat) for g in got) == [(0, 0, 30, 40.0), (0, 1, 30, 43.0)]
    assert spatial.clusters(spark.createDataFrame(rows, "id long, ts timestamp, lat double, lng double, confidence double").limit(0)).select(F.count("*")).first()[0] == 0


def test_a_dataset_from_what_landed(spark, tmp_path):
    for name in ("official", "sensors", "meteo", "fires"):
        (tmp_path / name).mkdir()
    data = [{"Stationid": "x", "ReadTime": f"2024-01-{d:02d}T00:00:00", "PM10": 10 + d} for d in (1, 2)]
    summary = [{"Parameter": "PM10", "Stationid": "x", "Count": 30, "MustBeCount": 48}]
    (tmp_path / "official" / "aq_16_2024-01-01_2024-01-20.json").write_text(json.dumps({"Object": {"Summaries": summary, "Data": data}}))
    (tmp_path / "sensors" / "airqoon_s_2024-01-01_2024-01-20.json").write_text(json.dumps({"PM25": [{"Value": 3, "Date": "2024-01-02T00:00"}]}))
    (tmp_path / "meteo" / "o.json").write_text(json.dumps({"daily": {"time": ["2024-01-01"], "temperature_2m_mean": [4.0], "wind_speed_10m_mean": [36.0]}}))
    (tmp_path / "fires" / "fires_firms_001.csv").write_text("latitude,longitude,acq_date,acq_time,confidence,frp\n40.0,29.0,2024-01-03,100,80,1\n41.5,29.0,2024-01-03,100,80,1\n")
    official = spark.createDataFrame([("x", "o", "Official", "official", 40.0, 29.0)], "source_id string, id string, name string, source string, lat double, lng double")
    sensors = spark.createDataFrame([("s", "City", "Sensor", "municipal-sensor", 40.1, 29.1)], "id string, operator string, name string, source string, lat double, lng double")
    known = [("c1", "fire", "Known", datetime.date(2024, 1, 5), datetime.date(2024, 1, 6), 40.1, 29.0, 5.0, "curated", 0.9, 0)]
    by_hand = spark.createDataFrame(known, "event_id string, kind string, name string, start_day date, end_day date, lat double, lng double, radius_km double, source string, confidence double, hotspot_count long")
    tables = landed.network_dataset(spark, str(tmp_path), official, sensors, "2024-01-01", "2024-01-20", by_hand)
    assert sorted((r.station, r.pollutant, r.value) for r in tables["series"].collect()) == [("o", "PM10", 11.0), ("o", "PM10", 12.0), ("s", "PM2.5", 3.0)]
    assert {r.id: r.pollutants for r in tables["stations"].collect()} == {"o": ["PM10"], "s": ["PM2.5"]}
    assert [(r.actual, r.expected, r.ratio) for r in tables["completeness"].collect()] == [(30, 48, 0.625)]
    # the fire 11 km from a known one and two days before it is the same; the other, 156 km away, is not
    assert sorted((r.event_id, r.lat) for r in tables["events"].collect()) == [("c1", 40.1), ("firms-fire-2", 41.5)]
    assert [(r.station, r.temperature, r.wind_speed) for r in tables["meteo"].collect()] == [("o", 4.0, 10.0)]
    assert [r.id for r in tables["issues"].collect()] == ["airqoon-network-added"]
    bare = landed.network_dataset(spark, str(tmp_path / "none"), official, sensors, "2024-01-01", "2024-01-20")
    assert set(bare) == {"series", "stations", "completeness", "issues"} and bare["series"].count() == 0 and [r.id for r in bare["stations"].collect()] == ["o"]


def test_known_events(spark):
    assert curated.events(spark).count() == 6 and set(landed.EVENT) <= set(curated.events(spark).columns)
    got = curated.events(spark, "2024-04-26", "2024-06-30").collect()
    assert sorted((e.kind, str(e.start_day), str(e.end_day)) for e in got) == [("dust-transport", "2024-04-24", "2024-04-26"), ("fire", "2024-06-30", "2024-07-01"), ("wind-event", "2024-06-14", "2024-06-14")]
