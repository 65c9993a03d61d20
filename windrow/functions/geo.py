"""Geometry on latitude and longitude as Columns; rings are arrays of structs (x, y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col

EARTH_M = 6_371_000.0


def haversine_m(lat1, lng1, lat2, lng2) -> Column:
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lng1, lat2, lng2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing(lat1, lng1, lat2, lng2) -> Column:
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lng1, lat2, lng2))
    y, x = F.sin(d - b) * F.cos(c), F.cos(a) * F.sin(c) - F.sin(a) * F.cos(c) * F.cos(d - b)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def angular_difference(a, b) -> Column:
    raw = F.abs(col(a) - col(b)) % 360
    return F.when(raw > 180, 360 - raw).otherwise(raw)


def projected(lat, lng, lat0: float, lng0: float) -> tuple[Column, Column]:
    """Metres east and north of an origin (equirectangular)."""
    k = F.lit(EARTH_M)
    return F.radians(col(lng) - lng0) * F.cos(F.radians(F.lit(lat0))) * k, F.radians(col(lat) - lat0) * k


def destination(lat, lng, distance_m, angle) -> tuple[Column, Column]:
    a, b, t, d = F.radians(col(lat)), F.radians(col(lng)), F.radians(col(angle)), col(distance_m) / EARTH_M
    to = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    return F.degrees(to), F.degrees(b + F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(to)))


def segment_distance(x, y, x1, y1, x2, y2) -> Column:
    x, y, x1, y1, x2, y2 = map(col, (x, y, x1, y1, x2, y2))
    square = F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / F.nullif(square, F.lit(0.0))))
    t = F.coalesce(t, F.lit(0.0))
    return F.sqrt(F.pow(x - x1 - t * (x2 - x1), 2) + F.pow(y - y1 - t * (y2 - y1), 2))


def _edges(ring: Column) -> Column:
    """Structs (p, q) of a ring's sides; the last joins its end to its start."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def ring_area(ring) -> Column:
    return F.abs(_total(F.transform(_edges(col(ring)), lambda e: e.p.x * e.q.y - e.q.x * e.p.y))) / 2


def ring_centroid(ring) -> tuple[Column, Column]:
    """Area-weighted; the signed area makes it right for either direction."""
    edges = _edges(col(ring))
    cross = lambda e: e.p.x * e.q.y - e.q.x * e.p.y
    six = F.nullif(3 * _total(F.transform(edges, cross)), F.lit(0.0))
    return tuple(_total(F.transform(edges, _moment(k, cross))) / six for k in ("x", "y"))


def _moment(k: str, cross):
    return lambda e: (e.p[k] + e.q[k]) * cross(e)


def in_ring(x, y, ring) -> Column:
    """Even-odd rule."""
    x, y = col(x), col(y)

    def crossed(e):
        rise = F.when(e.q.y == e.p.y, F.lit(1e-12)).otherwise(e.q.y - e.p.y)
        return ((e.p.y > y) != (e.q.y > y)) & (x < (e.q.x - e.p.x) * (y - e.p.y) / rise + e.p.x)

    return F.size(F.filter(_edges(col(ring)), crossed)) % 2 == 1


def cube(lat, lng, metres: float) -> Column:
    """The cube of an earth-centred grid that a place lies in, as a struct; places closer than `metres` are in the same one or
    in neighbours, anywhere on the globe."""
    lat, lng = F.radians(col(lat)), F.radians(col(lng))
    at = (F.cos(lat) * F.cos(lng), F.cos(lat) * F.sin(lng), F.sin(lat))
    return F.struct(*[F.floor(x * EARTH_M / metres).alias(n) for x, n in zip(at, "xyz", strict=True)])


def cubes_around(lat, lng, metres: float) -> Column:
    """The cube of a place and all its neighbours."""
    own, steps = cube(lat, lng, metres), [F.lit(i).cast("long") for i in (-1, 0, 1)]
    return F.array(*[F.struct((own.x + i).alias("x"), (own.y + j).alias("y"), (own.z + k).alias("z")) for i in steps for j in steps for k in steps])


def largest_ring(rings) -> Column:
    """Of an array of rings (structs x, y) the one with the largest area, of equal ones the first; null if there is none."""
    rings = col(rings)
    ranked = F.transform(rings, lambda r, i: F.struct(ring_area(r).alias("area"), (-i).alias("i")))
    return F.try_element_at(rings, 1 - F.array_max(ranked)["i"])


def vertex_centroid(ring) -> Column:
    """The mean of a ring's corners, a closing one left out, as a struct (x, y)."""
    ring = col(ring)
    n = F.size(ring)
    open_ = F.when((n > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1)), F.slice(ring, 1, F.greatest(n - 1, F.lit(1)))).otherwise(ring)
    mean = lambda c: F.try_divide(_total(F.transform(open_, lambda p: p[c])), F.size(open_))
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))
