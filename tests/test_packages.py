"""Surfaces and whole packages of a small network against plain versions; publishing that breaks off."""

import datetime
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.operators import packages, slices, spatial, surfaces
from windrow.sources import dataset

START, END, ORIGIN = "2024-01-10", "2024-04-30", (40.0, 29.0)
FIRST = datetime.date(2024, 1, 10)
K = math.pi / 180 * 6_371_000


@pytest.fixture(scope="module")
def inputs(spark):
    r = random.Random(11)
    at = {s: (40 + r.random() * 0.5, 29 + r.random() * 0.5) for s in range(12)}
    wave = lambda lat, lng: 60 + 30 * math.sin(9 * lat) + 20 * math.cos(7 * lng)
    daily = []
    for s, (lat, lng) in at.items():
        for d in range(112):
            day = FIRST + datetime.timedelta(days=d)
            if day.month == 3 and d % 2:  # March is half empty
                continue
            daily.append((s, "PM10", day, round(wave(lat, lng) + r.gauss(0, 1), 3)))
    stations = [(s, *p, scope) for s, p in at.items() for scope in (("all", "physical") if s < 5 else ("all",))]
    events = [("dust-1", datetime.date(2024, 1, 5), datetime.date(2024, 1, 14)), ("old", datetime.date(2020, 1, 1), datetime.date(2020, 1, 2))]
    meteo = [(s, FIRST + datetime.timedelta(days=d), float((s * 3 + 2 * d) % 360) if d % 5 else None) for s in at for d in range(0, 112, 2)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    cells = spatial.grid(spark, 40.0, 29.0, 40.5, 29.5, 12.0)
    width = cells.agg(F.max("col")).first()[0] + 1
    cells = cells.select((F.col("row") * width + F.col("col")).cast("int").alias("i"), "cell_id", "lat", "lng")
    i = F.col("i")
    contexts = cells.where("i > 0").select("cell_id", (i % 3 / 2).alias("road_density"), (i * 700.0).alias("nearest_industry_m"), (i % 4 / 4).alias("green_ratio"), (i % 5 / 9).alias("impervious_ratio"), (i * i * 3.0 % 100).alias("elevation"), (i % 7 * 1.0).alias("slope"), (i % 6 / 5).alias("proximity_index"))
    return packages.Inputs(frame(daily, "station long, pollutant string, day date, value double"), frame(stations, "id long, lat double, lng double, scope string"), frame(events, "event_id string, start_day date, end_day date"), frame(meteo, "station long, day date, wind_dir double"), cells, contexts, frame([(1, 40.1, 29.1), (2, 40.4, 29.4)], "id long, lat double, lng double"), START, END, ORIGIN)


@pytest.fixture(scope="module")
def built(inputs):
    return packages.build(inputs)


def xy(lat, lng):
    return np.array([(lng - ORIGIN[1]) * K * math.cos(math.radians(ORIGIN[0])), (lat - ORIGIN[0]) * K])


def plain_observations(inputs, first, last, scope):
    at = {s.id: (s.lat, s.lng) for s in inputs.stations.where(F.col("scope") == scope).collect()}
    out = {}
    for s in at:
        v = [x.value for x in inputs.daily.where(F.col("station") == s).collect() if first <= x.day <= last]
        if v:
            out[s] = (*at[s], statistics.mean(v), sum(x > 50 for x in v) / len(v), len(v))
    return out


def test_gates_and_observations(inputs, built):
    got = {(r.slice_id, r.scope): r for r in built["slices"].collect()}
    assert {k for k, _ in got} == {"month-2024-01", "month-2024-02", "month-2024-03", "month-2024-04", "event-dust-1"}
    assert {s for (_, s) in got} == {"all", "physical"}
    assert got["month-2024-03", "all"].status == "insufficient-completeness" and got["month-2024-03", "all"].failure == surfaces.SPARSE
    event, month = got["event-dust-1", "all"], got["month-2024-01", "all"]
    # of the event only the five days in the coverage count, so it is complete
    assert (event.status, event.mean_completeness, event.observation_count, str(event.start_day)) == ("ok", 1.0, 60, "2024-01-05")
    assert (month.status, month.observation_count, month.station_count) == ("ok", 12 * 22, 12)
    assert got["month-2024-01", "physical"].kriging_reason == surfaces.KRIGING_FEW
    assert got["month-2024-01", "physical"].stats_status == "insufficient-observations" and got["month-2024-01", "all"].hotspots == 12


def plain_kriging(obs, targets, column):
    keys = sorted(obs)
    p = [xy(*obs[k][:2]) for k in keys]
    v = [obs[k][column] for k in keys]
    far = sorted(float(np.linalg.norm(a - b)) for i, a in enumerate(p) for j, b in enumerate(p) if i != j)
    sill = max(statistics.variance([obs[k][2] for k in keys]), 1e-6)
    reach = max(1000.0, min(far[-1], far[len(far) // 2] * 1.75))
    gamma = lambda h: 0.0 if h <= 0 else 0.05 * sill + max(0.95 * sill, 1e-6) * (1 - math.exp(-h / reach))

    def at(to, rest):
        n = len(rest)
        a, b = np.zeros((n + 1, n + 1)), np.ones(n + 1)
        for i, k in enumerate(rest):
            a[i, n] = a[n, i] = 1
            b[i] = gamma(float(np.linalg.norm(p[k] - to)))
            for j, m in enumerate(rest):
                a[i, j] = gamma(float(np.linalg.norm(p[k] - p[m])))
        return float(np.linalg.solve(a, b)[:n] @ [v[k] for k in rest])

    every = list(range(len(p)))
    out = [at(t, every) for t in targets]
    errors = [at(p[i], [j for j in every if j != i]) - v[i] for i in every]
    return out, math.sqrt(statistics.mean(e * e for e in errors))


def test_both_surfaces_of_a_month(inputs, built):
    obs = plain_observations(inputs, datetime.date(2024, 2, 1), datetime.date(2024, 2, 29), "all")
    cells = sorted(inputs.cells.collect(), key=lambda c: c.i)
    got = {(r.method, r.cell_id): (r.value, r.exceedance) for r in built["surfaces"].where("slice_id = 'month-2024-02' and scope = 'all'").collect()}
    for column, part, digits in ((2, 0, 2), (3, 1, 4)):
        kriged, rmse = plain_kriging(obs, [xy(c.lat, c.lng) for c in cells], column)
        for c, k in zip(cells, kriged, strict=True):
            w = {s: 1 / max(float(np.linalg.norm(xy(c.lat, c.lng) - xy(*o[:2]))), 1.0) ** 2 for s, o in obs.items()}
            idw = sum(obs[s][column] * w[s] for s in obs) / sum(w.values())
            assert got["idw", c.cell_id][part] == pytest.approx(idw, abs=10**-digits)
            assert got["kriging", c.cell_id][part] == pytest.approx(k, abs=10**-digits)
        if column == 2:
            summary = built["slices"].where("slice_id = 'month-2024-02' and scope = 'all'").first()
            assert summary.kriging_rmse == pytest.approx(rmse, abs=1e-3) and summary.kriging_rmse < summary.idw_rmse and summary.kriging_reason is None
            values = [got["idw", c.cell_id][0] for c in cells]
            assert (summary["max"], summary["min"]) == (max(values), min(values)) and summary["median"] == pytest.approx(statistics.median(values), abs=0.011)
            assert [t.value for t in summary.top] == sorted(values, reverse=True)[:5] and summary.sd == pytest.approx(statistics.stdev(values), abs=0.011)


def test_kriging_without_a_variogram_or_an_advantage(spark, inputs):
    rows = [("m", "m", "PM10", "all", i, 40.1, 29.1, float(i), 0.0, 5, 1.0) for i in range(12)]
    rows += [("n", "n", "PM10", "all", i, 40 + i / 50, 29 + (i * 7 % 12) / 50, float(i % 2), 0.0, 5, 1.0) for i in range(12)]
    obs = spark.createDataFrame(rows, "slice_id string, label string, pollutant string, scope string, id long, lat double, lng double, value double, over double, days long, completeness double")
    got = {r.slice_id: r for r in surfaces.kriging_values(obs, inputs.cells.toPandas(), ORIGIN).collect()}
    assert got["m"].reason == surfaces.KRIGING_NO_VARIOGRAM and got["m"].idw_rmse is None
    assert (got["n"].reason == surfaces.KRIGING_NO_ADVANTAGE) == (got["n"].kriging_rmse >= got["n"].idw_rmse) and (got["n"]["values"] is None) == (got["n"].reason is not None)


def test_risks_of_a_month(inputs, built):
    where = "slice_id = 'month-2024-02' and scope = 'all'"
    idw = {r.cell_id: r.value for r in built["surfaces"].where(f"{where} and method = 'idw'").collect()}
    hot = [r for r in built["stations"].where(where).collect() if r.z > 0]
    radius = built["stats"].where(where).first().radius
    ctx = {c.cell_id: c for c in inputs.contexts.collect()}
    lo = {n: min(c[n] for c in ctx.values()) for n in ("slope", "elevation")}
    hi = {n: max(c[n] for c in ctx.values()) for n in ("slope", "elevation")}
    got = {r.cell_id: r for r in built["risks"].where(where).collect()}
    assert set(got) == set(idw)
    for c in inputs.cells.collect():
        near = [(min(1, h.z / 2.58), max(float(np.linalg.norm(xy(c.lat, c.lng) - xy(h.lat, h.lng))), 1.0)) for h in hot]
        near = [(s, 1 / d**2) for s, d in near if d <= max(radius, 10_000)]
        spot = sum(s * w for s, w in near) / sum(w for _, w in near) if near else 0.0
        x = ctx.get(c.cell_id)
        inverse = {n: 1 - (x[n] - lo[n]) / (hi[n] - lo[n]) if x else 0.0 for n in lo}
        relief = 0.6 * inverse["slope"] + 0.4 * inverse["elevation"]
        parts = (min(max(idw[c.cell_id] / 75, 0), 1), spot, min(1, x.proximity_index) if x else 0.0, 1 - x.green_ratio if x else 0.0, relief)
        score = sum(p * w for p, w in zip(parts, (0.4, 0.2, 0.2, 0.1, 0.1), strict=True))
        r = got[c.cell_id]
        assert (r.score, r.pollution, r.hotspot, r.proximity, r.green_deficit, r.relief) == pytest.approx((score, *parts), abs=2e-4)


def test_drivers_of_a_month(inputs, built):
    where = "slice_id = 'month-2024-02' and scope = 'all'"
    got = {r.driver: r for r in built["drivers"].where(where).collect()}
    wind = [math.radians(m.wind_dir) for m in inputs.meteo.collect() if m.wind_dir is not None and m.day.month == 2]
    mean = math.degrees(math.atan2(sum(map(math.sin, wind)), sum(map(math.cos, wind)))) % 360
    assert got["slope"].wind == pytest.approx(mean, abs=0.01) and set(got) == set(slices.DRIVERS)
    idw = {r.cell_id: r.value for r in built["surfaces"].where(f"{where} and method = 'idw'").collect()}
    at = {c.cell_id: (c.lat, c.lng) for c in inputs.cells.collect()}
    rows, y = [], []
    for c in inputs.contexts.collect():
        (lat, lng), best = at[c.cell_id], None
        for i in inputs.industries.collect():
            p, q, dl = math.radians(i.lat), math.radians(lat), math.radians(lng - i.lng)
            h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(dl / 2) ** 2
            bearing = math.degrees(math.atan2(math.sin(dl) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(dl)))
            best = min(best or (9e9,), (2 * 6_371_000 * math.asin(math.sqrt(h)), bearing))
        apart = abs((best[1] - round(mean, 2) - 180 + 180) % 360 - 180)
        blown = max(0.0, math.cos(math.radians(apart))) if best[0] <= 10_000 else 0.0
        rows.append((c.road_density, max(0, 1 - best[0] / 5000), c.green_ratio, c.impervious_ratio, c.elevation, c.slope, blown))
        y.append(idw[c.cell_id])
    x, y = np.array(rows), np.array(y)
    used = x.std(0) > 0
    coef = np.zeros(len(slices.DRIVERS))
    coef[used] = np.linalg.lstsq((x[:, used] - x[:, used].mean(0)) / x[:, used].std(0), (y - y.mean()) / y.std(), rcond=None)[0]
    assert [got[d].coefficient for d in slices.DRIVERS] == pytest.approx(coef.tolist(), abs=2e-3)
    assert {r.n for r in got.values()} == {len(y)}


def test_series_and_forecasts(inputs, built):
    series = packages.network_series(inputs.daily, inputs.stations, "2024-01-08", "2024-05-02").where("scope = 'all'").orderBy("day").collect()
    assert len(series) == 116 and [s.observed for s in series[:3]] == [False, False, True] and series[0].value == series[2].value and series[-1].value == series[-3].value
    got = {(r.scope, r.horizon_days): r for r in built["forecasts"].collect()}
    assert set(got) == {(s, h) for s in ("all", "physical") for h in (7, 30)}
    assert got["all", 7].supported == (got["all", 7].unavailable_reason is None) and (not got["all", 7].supported or len(got["all", 7].points) == 7)


def test_packages_are_published_and_answer_requests(spark, inputs, built, tmp_path):
    path = str(tmp_path / "p")
    with pytest.raises(FileNotFoundError):
        dataset.current(spark, path, ["slices"])
    assert dataset.publish_packages(built, path, "data-1", START, END) == "v00000001"
    about, tables = dataset.published_packages(spark, path, "PM10", ("all",))
    (row,) = about.collect()
    assert (row.scope, row.months, row.usable_months, row.events, row.dataset_version) == ("all", 4, 3, 1, "data-1")
    ask = lambda **k: slices.resolved(tables, slices.Request("2024-01-10", "2024-02-20", scope="all", **k))
    got = ask()
    a = got["answer"].first()
    # a range has the surfaces of months alone, and the statistics of events too
    assert (a.mode, a.slices_used, a.days, a.effective_method, a.fallback) == ("range", ["month-2024-01", "month-2024-02"], 42, "idw", False)
    idw = tables["surfaces"].where("method = 'idw'")
    cell = {(r.slice_id): r.value for r in idw.where("cell_id = 'r001c001'").collect()}
    want = (cell["month-2024-01"] * 22 + cell["month-2024-02"] * 20) / 42
    assert got["cells"].where("cell_id = 'r001c001'").first().value == pytest.approx(want)
    z = {r.slice_id: r.z for r in tables["stats"].where("station = 3").collect()}
    assert got["stations"].where("station = 3").first().z == pytest.approx((z["month-2024-01"] * 22 + z["month-2024-02"] * 20 + z["event-dust-1"] * 5) / 47, abs=1e-6)
    # an event is found whatever the range is; a missing one gives way to the range
    asked = slices.resolved(tables, slices.Request("2024-03-01", "2024-03-31", scope="all", slice_id="event-dust-1"))
    a = asked["answer"].first()
    assert (a.mode, a.label, a.slices_used, a.days, str(a.start_day)) == ("event", "dust-1", ["event-dust-1"], 10, "2024-01-05")
    assert asked["cells"].where("cell_id = 'r001c001'").first().value == pytest.approx(cell["event-dust-1"]) and asked["stations"].where("station = 3").first().z == pytest.approx(z["event-dust-1"])
    assert ask(slice_id="event-none")["answer"].first().slices_used == ["month-2024-01", "month-2024-02"]
    none = slices.resolved(tables, slices.Request("2024-03-01", "2024-03-31", scope="all"))["answer"].first()
    assert (none.slices_used, none.unsupported_reason) == ([], slices.NO_SLICE)
    physical = dataset.published_packages(spark, path, "PM10", ("physical",))[1]
    a = slices.resolved(physical, slices.Request("2024-01-10", "2024-02-20", method="kriging"))["answer"].first()
    assert (a.requested_method, a.effective_method, a.fallback, a.notice) == ("kriging", "idw", True, slices.FALLBACK)


def test_a_write_that_breaks_off_leaves_the_old_version(spark, tmp_path):
    path, one = str(tmp_path / "p"), spark.range(3)
    about = one.groupBy().count()
    broken = one.select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    assert dataset.publish({"a": one, "b": one}, path, about) == "v00000001"
    for tables in ({"a": spark.range(9), "b": broken}, {"b": broken, "a": spark.range(9)}):
        with pytest.raises(Exception, match="lost"):
            dataset.publish(tables, path, about)
        manifest, seen = dataset.current(spark, path, ["a", "b"])
        assert manifest.first()["count"] == 3 and seen["a"].count() == seen["b"].count() == 3
    with pytest.raises(Exception, match="lost"):
        dataset.publish({"a": spark.range(9)}, path, broken)
    assert dataset.current(spark, path, ["a"])[1]["a"].count() == 3
    assert dataset.publish({"a": spark.range(5), "b": one}, path, about) == "v00000005"
    assert dataset.current(spark, path, ["a"])[1]["a"].count() == 5
    assert dataset.cleared(spark, path) == ["v00000002", "v00000003", "v00000004"] and dataset.cleared(spark, path, keep=1) == ["v00000001"]
    assert dataset.current(spark, path, ["a"])[1]["a"].count() == 5
