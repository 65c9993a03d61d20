"""Landed networks, whole datasets, and kriging's gate against a plain version."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.functions import geo as G
from windrow.operators import spatial
from windrow.sources import dataset, networks


def test_backfill(spark):
    rows = [("a", {"time": ["2024-01-01T00:00", "2024-01-01T01:00", "2024-01-02T00:00"], "pm10": [1.0, 2.0], "pm2_5": None, "nitrogen_dioxide": [None, 4.0, 6.0], "sulphur_dioxide": [], "ozone": None})]
    got = networks.backfill(spark.createDataFrame(rows, networks.HOURLY)).collect()
    assert {(r.station, r.pollutant, str(r.day), r.value, r.quality_flag) for r in got} == {("modeled-a", "PM10", "2024-01-01", 1.5, "estimated"), ("modeled-a", "NO2", "2024-01-01", 4.0, "estimated"), ("modeled-a", "NO2", "2024-01-02", 6.0, "estimated")}


def test_official_sheets(spark):
    cells = {("S", 2): ("d2", "45000.0", "10"), ("S", 3): ("d1", "45000.01", "20"), ("S", 4): ("d1", "45000.5", "1,5"), ("S", 5): ("d1", "45000.6", "-3"), ("S", 6): ("d1", "40000", "9"), ("T", 2): ("d3", "45000", "x"), ("U", 2): ("d4", "45000", "5")}
    rows = [(s, r, n, v) for (s, r), values in cells.items() for n, v in zip(("device_id", "calculateddatetime", "pm10"), values, strict=True)]
    places = spark.createDataFrame([("S", "s-1", "Centre"), ("T", "t-1", "Hill")], "sheet string, id string, name string")
    got = networks.official_sheets(spark.createDataFrame(rows, "sheet string, row long, name string, value string"), places, {"pm10": "PM10"}, "2020-01-01", "2023-12-31")
    assert [(r.id, r.pollutant, str(r.day), r.value, r.hours) for r in got["records"].collect()] == [("s-1", "PM10", "2023-03-15", 8.25, 2)]
    assert [(r.id, r.name, r.pollutants, r.devices) for r in got["stations"].collect()] == [("s-1", "Centre", ["PM10"], "d1,d2")]
    assert {(r.kind, r.subject) for r in got["issues"].collect()} == {("location-missing", "U"), ("empty", "t-1")}


SQUARE = [[29.0, 40.0], [29.1, 40.0], [29.1, 40.1], [29.0, 40.1], [29.0, 40.0]]
HOLE = [[29.04, 40.04], [29.06, 40.04], [29.06, 40.06], [29.04, 40.06], [29.04, 40.04]]


@pytest.mark.parametrize("kind", ["bare", "feature", "features", "multi"])
def test_polygons(spark, tmp_path, kind):
    bare = {"type": "Polygon", "coordinates": [SQUARE, HOLE]}
    feature = {"type": "Feature", "properties": {"name": "N"}, "geometry": {"type": "MultiPolygon", "coordinates": [[SQUARE, HOLE]]} if kind == "multi" else bare}
    (tmp_path / "g.json").write_text(json.dumps({"bare": bare, "feature": feature}.get(kind, {"type": "FeatureCollection", "features": [feature]})))
    p = networks.polygons(spark, str(tmp_path / "g.json"))
    points = spark.createDataFrame([(29.01, 40.01), (29.05, 40.05), (29.2, 40.0)], "lng double, lat double")
    got = points.join(p).select("lng", networks.inside("lng", "lat").alias("i")).collect()
    assert {r.lng: r.i for r in got} == {29.01: True, 29.05: False, 29.2: False}


def test_neighbourhoods(spark):
    shape = "area string, name string, ring array<struct<x: double, y: double>>"
    far, tiny = [(x + 1, y) for x, y in SQUARE], [(29 + x / 1e4, 40 + y / 1e4) for x, y in ((0, 0), (1, 0), (1, 1))]
    areas = spark.createDataFrame([("in", "In", [tuple(p) for p in SQUARE]), ("far", "Far", far), ("tiny", "Tiny", tiny)], shape)
    stations = spark.createDataFrame([("b", "B", 40.05, 29.05), ("a", None, 40.06, 29.05), ("c", "C", 40.05, 29.5), ("d", "D", 41.0, 28.0)], "id string, district string, lat double, lng double")
    contexts = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 6.0), ("d", 100.0)], "station string, road_density double")
    got = {r.area: r for r in networks.neighbourhoods(areas, stations, contexts, 40.0, 29.0).collect()}
    assert set(got) == {"in", "far"} and (got["in"].stations, got["in"].district, got["in"].road_density) == (["a", "b"], "B", 1.5)
    assert (got["far"].stations, got["far"].district, got["far"].road_density) == ([], None, 3.0)
    assert abs(got["in"].km2 - 94.7) < 0.3


def test_elevation_grid(spark):
    got = networks.elevation_grid(spark, 40.0, 29.0, 41.2, 30.2).orderBy("cell").collect()
    assert len(got) == 36 and (round(got[7].lat, 6), round(got[7].lng, 6)) == (40.3, 29.3) and got[7].ring[0] == got[7].ring[-1]


def test_dataset(spark, tmp_path):
    (tmp_path / "a.csv").write_text("station_id,pollutant,value,timestamp,unit\nA,PM10,1,2024-01-01,ug/m3\nA,PM10,3,2024-01-01,ug/m3\nB x,NO2,5,2024-01-02,ug/m3\n")
    tables = dataset.built(spark, str(tmp_path / "a.csv"))
    dataset.write(tables, str(tmp_path / "out"), "v1")
    got = dataset.read(spark, str(tmp_path / "out"), ["series", "stations", "meteo"], "PM10", "v1")
    assert set(got) == {"series", "stations"} and [(r.station, r.value, r.quality_flag) for r in got["series"].collect()] == [("a", 2.0, "screened")]
    assert {(r.id, r.name, tuple(r.pollutants)) for r in got["stations"].collect()} == {("a", "A", ("PM10",)), ("b-x", "B X", ("NO2",))}
    counts = {(r.table, r.pollutant): r.n for r in spark.read.json(str(tmp_path / "out" / "manifest")).collect()}
    assert counts[("series", "PM10")] == 1 and counts[("stations", None)] == 2
    with pytest.raises(ValueError):
        dataset.read(spark, str(tmp_path / "out"), ["series"], version="v2")


def test_packages(spark, tmp_path):
    rows = [("PM10", "all", "month", "ok"), ("PM10", "all", "month", "insufficient-stations"), ("PM10", "all", "event", "ok"), ("O3", "all", "event", "ok")]
    dataset.write_packages(spark.createDataFrame(rows, "pollutant string, scope string, kind string, status string"), str(tmp_path))
    got = spark.read.json(f"{tmp_path}/packages-manifest").collect()
    assert {(r.pollutant, r.months, r.usable_months, r.events) for r in got} == {("PM10", 2, 1, 1), ("O3", 0, 0, 1)}


def test_kriging_gate(spark):
    r = np.random.default_rng(3)
    rows = [("wave", i, 40 + float(a), 29 + float(b), float(math.sin(6 * a) + math.cos(5 * b))) for i, (a, b) in enumerate(r.random((20, 2)))]
    rows += [("few", i, 40.0 + i / 10, 29.0, float(i)) for i in range(9)] + [("place", i, 40.0, 29.0, float(i)) for i in range(12)]
    points = spark.createDataFrame(rows, "net string, id long, lat double, lng double, value double")
    got = {x.net: x for x in spatial.kriging_gate(points, ["net"]).collect()}
    assert (got["few"].supported, got["few"].idw_rmse, got["place"].kriging_rmse) == (False, None, None)
    pts = [x for x in rows if x[0] == "wave"]
    lat0, lng0 = np.mean([x[2] for x in pts]), np.mean([x[3] for x in pts])
    k = math.pi / 180 * G.EARTH_M
    at = [((x[2] - lat0) * k, (x[3] - lng0) * k * math.cos(math.radians(lat0))) for x in pts]
    errors = []
    for i, p in enumerate(at):
        w = [(1 / max(math.dist(p, q), 1) ** 2, x[4]) for j, (q, x) in enumerate(zip(at, pts, strict=True)) if j != i]
        errors.append(sum(a * b for a, b in w) / sum(a for a, _ in w) - pts[i][4])
    assert abs(got["wave"].idw_rmse - math.sqrt(np.mean(np.square(errors)))) < 1e-4
    assert got["wave"].supported == (got["wave"].kriging_rmse < got["wave"].idw_rmse) and got["wave"].supported
    # ordinary kriging of each station from the others, under all stations' variogram
    apart = sorted(math.dist(p, q) for i, p in enumerate(at) for q in at[:i])
    sill, reach = np.var([x[4] for x in pts], ddof=1), min(max(1.75 * apart[len(apart) // 2], 1000), max(apart[-1], 1000))
    gamma = lambda p, q: 0.05 * sill + 0.95 * sill * (1 - math.exp(-math.dist(p, q) / reach)) if p != q else 0.0
    errors = []
    for i, p in enumerate(at):
        rest = [j for j in range(len(at)) if j != i]
        a = np.array([[gamma(at[j], at[k]) for k in rest] + [1.0] for j in rest] + [[1.0] * len(rest) + [0.0]])
        w = np.linalg.solve(a, np.array([gamma(at[j], p) for j in rest] + [1.0]))[:-1]
        errors.append(sum(x * pts[j][4] for x, j in zip(w, rest, strict=True)) - pts[i][4])
    assert abs(got["wave"].kriging_rmse - math.sqrt(np.mean(np.square(errors)))) < 1e-4


def test_sensors(spark):
    rows = spark.createDataFrame([("a - 1", 40.0, 29.0), ("b", 40.1, 29.1), ("c", 40.2, 29.0), ("d", None, 29.0)], "name string, lat double, lng double")
    got = networks.sensors(rows, (40.0, 29.0, 40.1, 29.1), F.upper("name")).collect()
    assert {r.name for r in got} == {"A - 1", "B"}
