"""Slices, fire clusters and permutation tests against plain versions."""

import datetime
import math
import random

import numpy as np
from pyspark.sql import functions as F

from windrow.operators import slices as L
from windrow.operators import spatial as X

EARTH_M = 6371000.0


def away(a, b):
    (lat, lng), (lat2, lng2) = a, b
    h = math.sin(math.radians(lat2 - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lng2 - lng) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1, math.sqrt(h)))


def plain_clusters(rows):
    found = []
    for r in sorted(rows, key=lambda x: (x[1], x[0])):
        for c in found:
            if r[1] - c[-1][1] <= datetime.timedelta(days=3) and away(r[2:4], c[-1][2:4]) <= 20_000:
                c.append(r)
                break
        else:
            found.append([r])
    return sorted((c[0][1], c[-1][1], len(c)) for c in found)


def test_fire_clusters(spark):
    r, t0 = random.Random(4), datetime.datetime(2024, 5, 1)
    rows = [(i, t0 + datetime.timedelta(minutes=r.randrange(60 * 24 * 40)), 40 + r.random() / 2, 29 + r.random() / 2, float(r.randrange(100))) for i in range(150)]
    rows += [(1000 + i, t0 + datetime.timedelta(days=100 + 3.5 * i), 40.0, 29.0, 50.0) for i in range(2)]  # 3.5 days apart: two
    rows += [(2000 + i, t0 + datetime.timedelta(days=200 + 3 * i), 40.0, 29.0, 50.0) for i in range(2)]  # 3 days apart: one
    got = X.clusters(spark.createDataFrame(rows, "id long, ts timestamp_ntz, lat double, lng double, confidence double")).collect()
    assert sorted((c.start, c.end, c.hotspots) for c in got) == plain_clusters(rows)
    assert all(c.radius_km >= 2 and 0 <= c.confidence <= 1 for c in got) and len({c.session for c in got}) >= 3


def test_moran_permutation(spark):
    r = random.Random(6)
    places = [(40 + r.random(), 29 + r.random()) for _ in range(9)]
    values = [r.random() * 50 for _ in places]
    rows = [("a", i, *p, v) for i, (p, v) in enumerate(zip(places, values, strict=True))]
    rows += [("few", i, *p, v) for i, (p, v) in enumerate(zip(places[:5], values, strict=False))]
    rows += [("flat", i, *p, 7.0) for i, p in enumerate(places)] + [("one place", i, 40.0, 29.0, v) for i, v in enumerate(values)]
    got = {x.k: x for x in X.moran_permutation(spark.createDataFrame(rows, "k string, id long, lat double, lng double, value double"), ["k"], "k").collect()}
    d = [[away(p, q) for q in places] for p in places]
    band = max(sorted(x for x in row if x > 0)[2] for row in d)

    def moran(v):
        m = sum(v) / len(v)
        near = [(i, j) for i in range(9) for j in range(9) if i != j and d[i][j] <= band]
        return len(v) / len(near) * sum((v[i] - m) * (v[j] - m) for i, j in near) / sum((x - m) ** 2 for x in v)

    own, shuffled, rng, draws = moran(values), values[:], random.Random("a"), []
    for _ in range(59):
        rng.shuffle(shuffled)
        draws.append(moran(shuffled))
    z = (own - np.mean(draws)) / np.std(draws, ddof=1)
    p = (sum(abs(x) >= abs(own) for x in draws) + 1) / 60
    assert (got["a"].radius, got["a"].moran_i, got["a"].z, got["a"].p_value) == (round(band, 2), round(own, 4), round(z, 4), round(p, 4))
    assert got["few"].radius is None and got["few"].moran_i is None and got["one place"].radius is None
    assert got["flat"].radius == round(band, 2) and got["flat"].moran_i is None and got["flat"].z is None


def test_forecast_slices(spark):
    day = datetime.date(2024, 1, 1)
    rows = [("long", day + datetime.timedelta(days=i), 10.0 + i % 7, True) for i in range(120)]
    rows += [("short", day + datetime.timedelta(days=i), 10.0, True) for i in range(80)] + [("sparse", day + datetime.timedelta(days=i), 10.0, i % 2 == 0) for i in range(120)]
    got = {(x.k, x.horizon_days): x for x in L.forecast_slices(spark.createDataFrame(rows, "k string, day date, value double, observed boolean"), ["k"]).collect()}
    assert len(got) == 6
    week = got["long", 7]
    assert week.supported and len(week.points) == 7 and week.points[0].day == day + datetime.timedelta(days=120) and week.mae is not None
    assert all(abs((p.upper - p.lower) / 2 - 1.64 * week.rmse) < 0.01 for p in week.points)
    assert len(got["long", 30].points) == 30
    assert "90" in got["short", 7].unavailable_reason and "75" in got["sparse", 7].unavailable_reason
    assert all(got[k, 7].points is None and got[k, 7].rmse is None for k in ("short", "sparse"))


def test_upsert_and_choice(spark):
    schema = "slice_id string, kind string, label string, start_day date, end_day date, scope string, value double"
    d = datetime.date
    old = [("a", "month", "A", d(2024, 1, 1), d(2024, 1, 31), "physical", 1.0), ("b", "month", "B", d(2024, 2, 1), d(2024, 2, 29), "physical", 2.0)]
    new = [("b", "month", "other", d(2024, 2, 1), d(2024, 2, 29), "physical", 5.0), ("b", "month", "B", d(2024, 2, 1), d(2024, 2, 29), "all", 6.0), ("c", "event", "C", d(2024, 1, 5), d(2024, 1, 6), "all", 7.0)]
    out = L.upserted(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["value"]).collect()
    assert [(x.slice_id, x.label, x.physical_value, x.all_value) for x in out] == [("a", "A", 1.0, None), ("c", "C", None, 7.0), ("b", "B", 5.0, 6.0)]
    slices = spark.createDataFrame(new, schema)
    assert {x.slice_id for x in L.overlapping_slice(slices, "2024-01-01", "2024-03-01", "c").collect()} == {"c"}
    assert {x.slice_id for x in L.overlapping_slice(slices, "2024-01-01", "2024-03-01", "missing").collect()} == {"b", "c"}


def test_join_of_neighbours_misses_no_pair(spark):
    from windrow.operators import layers

    r = random.Random(9)
    points = [(i, r.uniform(-89, 89), r.uniform(-180, 180)) for i in range(60)] + [(100, 10.0, 179.9999), (101, 89.9999, 0.0)]
    features = [(lat + r.uniform(-0.01, 0.01), max(-180.0, min(180.0, lng + r.uniform(-0.01, 0.01))), 1.0) for _, lat, lng in points for _ in range(3)] + [(10.0, -179.9999, 1.0), (89.9999, 180.0, 1.0)]
    got = layers.buffers(spark.createDataFrame(points, "id long, lat double, lng double"), spark.createDataFrame(features, "lat double, lng double, area double"))
    got = {(x.id, x.radius): x.features for x in got.collect()}
    want = {(i, m): sum(away((lat, lng), f[:2]) <= m for f in features) for i, lat, lng in points for m in (250, 500, 1000)}
    assert got == want and want[100, 250] and want[101, 250] and F


def test_upserts_of_statistics_risks_and_drivers(spark):
    """Slices of each payload: new ones are added, known ones replaced within their scope, the other scope's stay."""
    day = datetime.date
    about = "slice_id string, kind string, label string, start_day date, end_day date, scope string, "
    m1, m2 = ("month-1", "month", "1", day(2024, 1, 1), day(2024, 1, 31)), ("month-2", "month", "2", day(2024, 2, 1), day(2024, 2, 29))
    renamed = ("month-1", "month", "other", day(2024, 1, 2), day(2024, 1, 30))
    payloads = {
        "moran_i double, hotspots array<string>": [(0.1, ["a"]), (0.2, []), (0.3, ["b", "c"]), (None, None)],
        "top struct<cell: string, score: double>, label_counts map<string, int>": [(("c1", 0.5), {"Orta": 1}), (("c2", 0.6), {}), (("c3", 0.7), None), (None, {"Dusuk": 2})],
        "coefficients array<struct<driver: string, value: double>>, wind double": [([("slope", 0.1)], 10.0), ([], None), ([("slope", 0.3), ("wind", 0.2)], 20.0), (None, 5.0)],
    }
    for schema, p in payloads.items():
        names = [c.split()[0] for c in schema.replace("<cell: string, score: double>", "").replace("<string, int>", "").split(", ") if c.split()[0] in ("moran_i", "hotspots", "top", "label_counts", "coefficients", "wind")]
        old = spark.createDataFrame([(*m1, "physical", *p[0]), (*m1, "all", *p[1])], about + schema)
        new = spark.createDataFrame([(*renamed, "all", *p[2]), (*m2, "physical", *p[3])], about + schema)
        got = [r.asDict(recursive=True) for r in L.upserted(old, new, names).collect()]
        want = [r.asDict(recursive=True) for r in spark.createDataFrame([(*m1, "physical", *x) for x in p], about + schema).collect()]
        assert [(r["slice_id"], r["label"], r["start_day"]) for r in got] == [("month-1", "1", day(2024, 1, 1)), ("month-2", "2", day(2024, 2, 1))]
        for n in names:
            assert (got[0][f"physical_{n}"], got[0][f"all_{n}"], got[1][f"physical_{n}"], got[1][f"all_{n}"]) == (want[0][n], want[2][n], want[3][n], None)
