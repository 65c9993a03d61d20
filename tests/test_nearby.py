"""Joins by place against all pairs: scattered, crowded, far and repeated places."""

import math
import random

import pytest
from pyspark.sql import functions as F

from windrow.operators import layers, nearby


def haversine(a, b):
    p, q, r, s = map(math.radians, (*a, *b))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))


def places(seed: int) -> list[tuple]:
    r = random.Random(seed)
    crowd = [(40 + r.gauss(0, 0.001), 29 + r.gauss(0, 0.001)) for _ in range(60)]
    wide = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(60)]
    same, edge = [(10.0, 10.0)] * 4, [(0.0, 179.9999), (0.0, -179.9999), (90.0, 0.0), (-90.0, 5.0)]
    return [(i, *p) for i, p in enumerate(crowd + wide + same + edge)]


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_points(spark, k):
    left, right = places(1), [(i + 60, *p) for i, *p in places(2)]
    got = {}
    for r in nearby.nearest(spark.createDataFrame([*left, (999, None, None)], "id long, lat double, lng double"), spark.createDataFrame(right, "id long, lat double, lng double"), k).collect():
        got.setdefault(r.id, {})[r.rank] = (r.other, r.metres)
    for i, *p in left:
        want = sorted((round(haversine(p, q), 3), j) for j, *q in right if j != i)[:k]
        assert [got[i][n + 1][1] for n in range(k)] == pytest.approx([m for m, _ in want], abs=2e-3)
        assert all(got[i][n + 1][0] == j or abs(haversine(p, right[got[i][n + 1][0] - 60][1:]) - m) < 2e-3 for n, (m, j) in enumerate(want))
    assert 999 not in got


def test_nearest_among_fewer_than_asked_for(spark):
    two = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0)], "id long, lat double, lng double")
    assert [(r.id, r.other, r["rank"]) for r in nearby.nearest(two, two, 5).orderBy("id").collect()] == [(1, 2, 1), (2, 1, 1)]
    assert nearby.nearest(two, two.limit(0), 2).count() == nearby.nearest(two.limit(0), two, 2).count() == 0


def test_nearest_sides_and_reach(spark):
    r = random.Random(3)
    points = [(i, r.uniform(-40_000, 40_000), r.uniform(-40_000, 40_000)) for i in range(80)]
    ends = [(r.uniform(-40_000, 40_000), r.uniform(-40_000, 40_000)) for _ in range(30)]
    sides = [(*p, p[0] + r.choice((0, 30, 900, 25_000)), p[1] + r.choice((0, 50, 7_000))) for p in ends]

    def far(p, s):
        x1, y1, x2, y2 = s
        n = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = max(0, min(1, ((p[0] - x1) * (x2 - x1) + (p[1] - y1) * (y2 - y1)) / n)) if n else 0
        return math.dist(p, (x1 + t * (x2 - x1), y1 + t * (y2 - y1)))

    left = spark.createDataFrame(points, "i long, x double, y double")
    got = {q.i: q.metres for q in layers.nearest_segment(left, spark.createDataFrame(sides, "x1 double, y1 double, x2 double, y2 double"), "i").collect()}
    assert got == {i: pytest.approx(min(far(p, s) for s in sides)) for i, *p in points}
    near = nearby.within(left, spark.createDataFrame([(*e, n) for n, e in enumerate(ends)], "x double, y double, n long"), ["x", "y"], 9000.0)
    assert {(q.i, q.n) for q in near.collect()} == {(i, n) for i, *p in points for n, e in enumerate(ends) if math.dist(p, e) <= 9000}


def test_pairs_in_blocks_are_all_pairs_once(spark):
    left, right = spark.range(37).withColumnRenamed("id", "a"), spark.range(11).select(F.col("id").alias("block"))
    pairs = nearby.paired(left, right, "a")
    assert pairs.count() == pairs.distinct().count() == 37 * 11
    plan = nearby.paired(left, right, "a")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
