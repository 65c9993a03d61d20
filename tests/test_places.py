"""Stations that share places: figures against all pairs of stations, and the work that they make."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_nearby import haversine

from windrow.operators import layers, nearby, spatial


def made(df) -> int:
    """The most rows that any step of a query made."""
    df.collect()

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        found = node.metrics().get("numOutputRows")
        children = node.children()
        return max([found.get().value() if found.isDefined() else 0, *[walk(children.apply(i)) for i in range(children.size())]])

    return walk(df._jdf.queryExecution().executedPlan())


def stations(seed: int = 5) -> list[tuple]:
    r = random.Random(seed)
    at = [(40 + r.random(), 29 + r.random()) for _ in range(14)]
    rows = [("a", i, *at[i % 11], r.random() * 50) for i in range(40)] + [("b", i, *p, r.random() * 9) for i, p in enumerate(at)]
    return rows + [("one place", i, 40.0, 29.0, float(i)) for i in range(3)] + [("one", 0, 40.0, 29.0, 1.0)]


SCHEMA = "k string, id long, lat double, lng double, value double"


def pairs(rows, k):
    own = [x for x in rows if x[0] == k]
    return own, [(p, q, haversine(p[2:4], q[2:4])) for p in own for q in own if p[1] != q[1]]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(stations(), SCHEMA)


@pytest.fixture(scope="module")
def crowd(spark):
    """1500 stations in 15 places of one group: over two million pairs."""
    i = F.col("id")
    return spark.range(1500).select(F.lit("a").alias("k"), "id", (40 + i % 15 * 0.01).alias("lat"), (29 + i % 15 * i % 15 * 0.01).alias("lng"), (i * 37 % 100).cast("double").alias("value"))


def test_radius_moran_hotspots(points):
    radius, moran = ({x.k: x for x in f(points, ["k"]).collect()} for f in (spatial.adaptive_radius, spatial.moran))
    z = {(x.k, x.id): x.z for x in spatial.getis_ord(points, ["k"]).collect()}
    assert set(radius) == set(moran) == {"a", "b"} and len(z) == len(stations())
    for k in "ab":
        own, met = pairs(stations(), k)
        band = max(sorted(d for p, _, d in met if p[1] == i and d > 0)[2] for _, i, *_ in own)
        assert radius[k].radius == pytest.approx(band) and moran[k].radius == pytest.approx(band)
        v = [x[4] for x in own]
        m, near = statistics.fmean(v), [(p, q) for p, q, d in met if d <= radius[k].radius]
        assert (moran[k].n, moran[k].links) == (len(own), len(near))
        assert moran[k].moran_i == pytest.approx(statistics.fmean((p[4] - m) * (q[4] - m) for p, q in near) / statistics.pvariance(v))
        for p in own:
            inside = [q[4] for o, q in near if o == p] + [p[4]]
            n, w = len(own), len(inside)
            scale = statistics.stdev(v) * math.sqrt((n * w - w * w) / (n - 1))
            assert z[k, p[1]] == pytest.approx((sum(inside) - m * w) / scale if scale else 0, abs=2e-6)
    assert z["one place", 2] == pytest.approx((2.0 - 1.0) / (1.0 * math.sqrt((3 - 1) / 2)), abs=2e-6)


def test_left_out_and_variogram(points):
    left, model = {x.k: x for x in spatial.idw_loocv(points, ["k"]).collect()}, {x.k: x for x in layers.variogram(points, ["k"]).collect()}
    assert set(left) == {"a", "b", "one place"} and set(model) == {"a", "b"}
    for k in left:
        own, met = pairs(stations(), k)
        errors = []
        for p in own:
            w = [(1 / max(d, 1) ** 2, q[4]) for o, q, d in met if o == p]
            errors.append(p[4] - sum(a * b for a, b in w) / sum(a for a, _ in w))
        assert left[k].n == len(own) and left[k].rmse == pytest.approx(math.sqrt(statistics.fmean(e * e for e in errors)))
        if k in model:
            d = sorted(d for *_, d in met if d > 0)
            assert model[k].range_m == pytest.approx(max(1000, min(d[-1], 1.75 * d[len(d) // 2]))) and model[k].sill == pytest.approx(statistics.variance([x[4] for x in own]))


@pytest.mark.parametrize("f", [spatial.adaptive_radius, spatial.moran, spatial.getis_ord, spatial.idw_loocv, layers.variogram])
def test_stations_in_one_place_make_no_pairs(crowd, f):
    assert made(f(crowd, ["k"])) < 60_000


def test_nearest_and_buffers_of_shared_places(spark, points, crowd):
    rows = [x for x in stations() if x[0] == "a"]
    own = points.where("k = 'a'")
    for k in (1, 3):
        got = {(x.id, x["rank"]): (x.metres, x.other) for x in nearby.nearest(own, own, k).collect()}
        for p in rows:
            want = sorted((round(haversine(p[2:4], q[2:4]), 3), q[1]) for q in rows if q[1] != p[1])[:k]
            assert [got[p[1], n + 1] for n in range(k)] == want
    buffers = {(x.id, x.radius): (x.features, x.area) for x in layers.buffers(own, own.withColumn("area", F.col("value")), (1, 30_000)).collect()}
    for p in rows:
        for radius in (1, 30_000):
            near = [q[4] for q in rows if haversine(p[2:4], q[2:4]) <= radius]
            assert buffers[p[1], radius] == (len(near), pytest.approx(sum(near)))
    assert made(nearby.nearest(crowd, crowd, 3)) < 60_000 and made(layers.buffers(crowd, crowd.withColumn("area", F.lit(1.0)))) < 60_000


def test_repeated_rows_are_not_broadcast(spark, points):
    a, b = (points.where("k = 'a'").select(F.col("id").alias(c), "lat", "lng") for c in "ab")
    for df in (nearby.candidates(a, b, "a", ["lat", "lng"]), nearby.within(a, b, ["lat", "lng"], 1.0), nearby.paired(a, b.select("b"), "a")):
        assert "SortMergeJoin" in (plan := df._jdf.queryExecution().executedPlan().toString()) and "BroadcastHashJoin" not in plan


def test_distances_are_met_in_blocks(points):
    got = {(x.k, x.a, x.b): x.metres for x in spatial.distances(points, ["k"]).collect()}
    want = {(k, p[1], q[1]): pytest.approx(d, abs=1e-6) for k in ("a", "b", "one place", "one") for p, q, d in pairs(stations(), k)[1]}
    assert got == want and "block" in spatial.distances(points, ["k"])._jdf.queryExecution().optimizedPlan().toString()


def test_kriging_solves_places(spark):
    rows = [x for x in stations(8) if x[0] in "ab"]
    cells = spark.createDataFrame([("c", 40.3, 29.4), ("d", 40.8, 29.1)], "cell_id string, lat double, lng double").toPandas()
    points = spark.createDataFrame(rows, SCHEMA)
    got = {(x.k, x.cell_id): x.value for x in spatial.kriging(points, cells, ["k"]).collect()}
    gate = {x.k: x for x in spatial.kriging_gate(points, ["k"]).collect()}
    for k in "ab":
        own = points.where(F.col("k") == k).toPandas().sort_values("id")
        p = spatial.metres(own, own[["lat", "lng"]].mean().to_numpy())
        v, d = own["value"].to_numpy(), spatial.apart(p, p)
        gamma = spatial.fitted(d, v)

        def least(keep, to, d=d, v=v, gamma=gamma):  # stations that share a place get equal weights from least squares
            n = keep.sum()
            a = np.ones((n + 1, n + 1))
            a[:n, :n], a[n, n] = gamma(d[np.ix_(keep, keep)]), 0
            return v[keep] @ np.linalg.lstsq(a, np.append(gamma(to), 1.0), rcond=1e-11)[0][:n]

        every = np.ones(len(v), bool)
        for cell, at in zip("cd", spatial.metres(cells, own[["lat", "lng"]].mean().to_numpy()), strict=True):
            assert got[k, cell] == pytest.approx(least(every, np.linalg.norm(p - at, axis=1)), rel=1e-6)
        errors = [least(rest := np.arange(len(v)) != i, d[rest, i]) - v[i] for i in range(len(v))]
        w = np.where(np.eye(len(v), dtype=bool), 0, 1 / np.maximum(d, 1) ** 2)
        assert gate[k].kriging_rmse == pytest.approx(math.sqrt(np.mean(np.square(errors))), abs=2e-4) and gate[k].n == len(v)
        assert gate[k].idw_rmse == pytest.approx(math.sqrt(np.mean((w @ v / w.sum(1) - v) ** 2)), abs=1e-4)


def test_permutations_of_shared_places(spark):
    rows = [x for x in stations() if x[0] == "a"]
    got = spatial.moran_permutation(spark.createDataFrame(rows, SCHEMA), ["k"], "k").first()
    d = np.array([[haversine(p[2:4], q[2:4]) for q in rows] for p in rows])
    band = max(np.sort(r[r > 0])[2] for r in d)
    w = (d <= band) & ~np.eye(len(rows), dtype=bool)

    def moran(v):
        z = np.array(v) - np.mean(v)
        return len(v) / w.sum() * (z @ w @ z) / (z @ z)

    values, r, draws = [x[4] for x in rows], random.Random("a"), []
    own = moran(values)
    for _ in range(59):
        r.shuffle(values)
        draws.append(moran(values))
    assert (got.n, got.radius, got.moran_i) == (40, round(band, 2), round(own, 4))
    assert got.z == pytest.approx((own - np.mean(draws)) / np.std(draws, ddof=1), abs=2e-4) and got.p_value == round((sum(abs(x) >= abs(own) for x in draws) + 1) / 60, 4)


def test_large_groups_of_few_places_fit_a_task(spark):
    i = F.col("id")
    crowd = spark.range(60_000).select(F.lit("a").alias("k"), "id", (40 + i % 15 * 0.01).alias("lat"), (29 + i % 15 * i % 15 * 0.01).alias("lng"), (i * 37 % 100).cast("double").alias("value"))
    cells = spark.createDataFrame([("c", 40.3, 29.4)], "cell_id string, lat double, lng double").toPandas()
    assert spatial.moran_permutation(crowd, ["k"], "k").first().n == spatial.kriging_gate(crowd, ["k"]).first().n == 60_000
    assert spatial.kriging(crowd, cells, ["k"]).count() == 1


def test_matrix_in_lists(spark, tmp_path, monkeypatch):
    """Pairs as `distances` has them, also of points without a place, an id or a group, and of ids that are there twice; rows of few
    places take less than half a byte each where they are written (1.5 from `distances`)."""
    odd = [("a", 3, 40.5, 29.5, 0.0), ("a", 900, None, 29.0, 1.0), ("a", None, 40.0, 29.0, 1.0), (None, 1, 40.0, 29.0, 1.0), ("b", 901, -0.0, 0.0, 1.0), ("b", 902, 0.0, -0.0, 1.0)]
    points = spark.createDataFrame(stations() + odd, SCHEMA)
    want = sorted(spatial.distances(points, ["k"]).select("k", "a", "b", F.round("metres", 4)).collect(), key=str)
    monkeypatch.setattr(spatial, "LIST", 3)
    assert sorted(spatial.matrix(points, ["k"]).collect(), key=str) == want
    monkeypatch.undo()
    r = random.Random(3)
    at = [(40 + r.random(), 29 + r.random()) for _ in range(12)]
    many = spark.createDataFrame([("a", i * 1000, *at[i % 12], 0.0) for i in range(1500)], SCHEMA)
    spatial.matrix(many, ["k"]).write.parquet(str(tmp_path / "rows"))
    rows, size = spark.read.parquet(str(tmp_path / "rows")).count(), sum(f.stat().st_size for f in (tmp_path / "rows").glob("*.parquet"))
    assert rows == 1500 * 1499 and 2 * size < rows
