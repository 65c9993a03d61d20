"""Trends against all pairs, grids against plain loops."""

import math
import random
import statistics

import numpy as np
import pytest

from windrow.operators import grids, temporal


@pytest.mark.parametrize("seed", range(30))
def test_rises_and_median_slopes(seed):
    r = random.Random(seed)
    n = r.choice((2, 3, 4, 5, 17, 64, 101))
    v = np.array([r.choice((r.gauss(0, 1), r.randint(0, 3), i / 7)) * 10 ** r.choice((0, 3)) for i in range(n)])
    if seed == 7:
        v[:] = 4.0
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    assert temporal.rises(v) == (sum(v[j] > v[i] for i, j in pairs), sum(v[j] < v[i] for i, j in pairs))
    assert temporal.median_slope(v) == pytest.approx(statistics.median((v[j] - v[i]) / (j - i) for i, j in pairs), rel=1e-9, abs=1e-9)


def test_trends_skip_missing_values(spark):
    rows = [("a", i, float(i) if i % 3 else None) for i in range(12)] + [("b", i, None) for i in range(5)]
    got = temporal.mann_kendall(spark.createDataFrame(rows, "k string, t int, value double"), ["k"], "t").collect()
    assert [(g.k, g.tau, g.slope > 0, g.direction) for g in got] == [("a", 1.0, True, "increasing")]


RINGS = "rings array<array<struct<x: double, y: double>>>"


def plain_in(lng, lat, polygons):
    def ring(r):
        inside = False
        for (x1, y1), (x2, y2) in zip(r, [*r[1:], r[0]], strict=True):
            if (y1 > lat) != (y2 > lat) and lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                inside = not inside
        return inside

    return any(ring(p[0]) and not any(ring(h) for h in p[1:]) for p in polygons)


def test_clipped_grid(spark):
    polygons = [[[(29.0, 40.0), (29.6, 40.1), (29.5, 40.5), (29.1, 40.4)], [(29.2, 40.2), (29.35, 40.2), (29.35, 40.3), (29.2, 40.3)]], [[(29.7, 40.0), (29.9, 40.0), (29.9, 40.2), (29.7, 40.2), (29.7, 40.0)]]]
    boundary = spark.createDataFrame([(p,) for p in polygons], RINGS)
    points = spark.createDataFrame([(40.2, 29.2)], "lat double, lng double")
    dlat, dlng = 5 / 110.574, 5 / (111.32 * math.cos(math.radians(40.25)))
    want, lat, row = {}, 40.0 + dlat / 2, 0
    while lat <= 40.5:
        lng, col = 29.0 + dlng / 2, 0
        while lng <= 29.9:
            if plain_in(lng, lat, polygons):
                want[f"r{row:03d}c{col:03d}"] = (lat, lng)
            lng, col = lng + dlng, col + 1
        lat, row = lat + dlat, row + 1
    got = {c.cell_id: c for c in grids.clipped(boundary, points).collect()}
    assert set(got) == set(want) and len(want) > 20
    for k, (lat, lng) in want.items():
        c = got[k]
        assert (c.lat, c.lng) == pytest.approx((lat, lng), abs=1e-6)
        assert c.ring[0] == c.ring[4] and len(c.ring) == 5 and (c.ring[2].x - c.ring[0].x, c.ring[2].y - c.ring[0].y) == pytest.approx((dlng, dlat), abs=2e-6)
        assert c.y == pytest.approx(math.radians(lat - 40.0) * 6_371_000, abs=1e-2)


def test_where_extents_come_from(spark):
    points = spark.createDataFrame([(40.2, 29.2), (40.4, 29.5)], "lat double, lng double")
    none, line = spark.createDataFrame([], RINGS), spark.createDataFrame([([[(29.0, 40.0), (29.1, 40.0), (29.0, 40.0)]],)], RINGS)
    sides = lambda b, p: tuple(grids.extent(b, p).first())
    assert sides(line, points) == (40.0, 29.0, 40.0, 29.1)
    assert sides(none, points) == sides(None, points) == pytest.approx((40.15, 29.15, 40.45, 29.55))
    assert sides(none, points.limit(0)) == grids.EXTENT
    # a boundary in which no centre lies gives way to all cells of the points' extent
    every = {c.cell_id for c in grids.clipped(none, points).collect()}
    assert every == {c.cell_id for c in grids.clipped(line, points).collect()} and len(every) == 7 * 7
