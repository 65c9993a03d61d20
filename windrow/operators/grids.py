"""Grids of cells over an extent: where the extent comes from, closed cells, and clipping by a boundary with holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions import geo as G

CELL_KM = 5.0
PAD = 0.05
# fixed values: the extent (south, west, north, east) where nothing else gives one; kilometres of a degree
EXTENT = (39.55, 28.05, 40.8, 29.95)
LAT_KM, LNG_KM = 110.574, 111.320
SIDES = ("south", "west", "north", "east")


def _sides(points: DataFrame, pad: float) -> DataFrame:
    """One row: the extent of points (lat, lng), padded, 6 digits; nulls if there are none."""
    ends = (F.min("lat") - pad, F.min("lng") - pad, F.max("lat") + pad, F.max("lng") + pad)
    return points.agg(*[F.round(e, 6).alias(n) for n, e in zip(SIDES, ends, strict=True)])


def corners(boundary: DataFrame) -> DataFrame:
    """(lat, lng) of all rings of a boundary's polygons (rings: arrays of structs x, y; the first is the outline, others holes)."""
    return boundary.select(F.explode(F.flatten("rings")).alias("p")).select(F.col("p.y").alias("lat"), F.col("p.x").alias("lng"))


def extent(boundary: DataFrame | None, points: DataFrame) -> DataFrame:
    """One row (SIDES): the boundary's extent, else that of the points with a margin, else the fixed one."""
    found = [_sides(corners(boundary), 0.0)] if boundary is not None else []
    found.append(_sides(points, PAD))
    rows = None
    for rank, df in enumerate(found):
        own = df.select(F.lit(rank).alias("rank"), F.struct(*SIDES).alias("e")).where("e.south is not null")
        rows = own if rows is None else rows.unionByName(own)
    best = rows.agg(F.min_by("e", "rank").alias("e"))
    return best.select(*[F.coalesce(F.col(f"e.{n}"), F.lit(v)).alias(n) for n, v in zip(SIDES, EXTENT, strict=True)])


def in_polygons(lng, lat, polygons: Column) -> Column:
    """Whether a place is in one of polygons (arrays of rings): inside its outline and in none of its holes."""
    whole = lambda r: F.size(r) >= 3

    def within(rings: Column) -> Column:
        holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
        return (F.size(rings) > 0) & whole(F.get(rings, F.lit(0))) & G.in_ring(lng, lat, F.get(rings, F.lit(0))) & ~F.exists(holes, lambda h: whole(h) & G.in_ring(lng, lat, h))

    return F.exists(polygons, within)


def cells(extents: DataFrame, km: float = CELL_KM) -> DataFrame:
    """Cells of an extent (one row of SIDES), made where the row is: cell_id, row, col, the centre's lat and lng, its metres x and y
    from the south-west corner, and the closed ring of its corners (x = lng, y = lat). Centres lie in the extent."""
    mid = F.radians((F.col("south") + F.col("north")) / 2)
    e = extents.select(*SIDES, F.lit(km / LAT_KM).alias("dlat"), (km / (LNG_KM * F.greatest(F.cos(mid), F.lit(0.25)))).alias("dlng"))
    last = lambda lo, hi, step: F.floor((F.col(hi) - F.col(lo) - F.col(step) / 2) / F.col(step))
    rows = e.where((last("south", "north", "dlat") >= 0) & (last("west", "east", "dlng") >= 0))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last("south", "north", "dlat"))).alias("row"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last("west", "east", "dlng"))).alias("col"))
    rows = rows.withColumns({"clat": F.col("south") + F.col("dlat") / 2 + F.col("row") * F.col("dlat"), "clng": F.col("west") + F.col("dlng") / 2 + F.col("col") * F.col("dlng")})
    corner = lambda a, b: F.struct(F.round(F.col("clng") + b * F.col("dlng") / 2, 6).alias("x"), F.round(F.col("clat") + a * F.col("dlat") / 2, 6).alias("y"))
    ring = F.array(*[corner(a, b) for a, b in ((-1, -1), (-1, 1), (1, 1), (1, -1), (-1, -1))])
    x = F.radians(F.col("clng") - F.col("west")) * F.cos(F.radians("south")) * G.EARTH_M
    y = F.radians(F.col("clat") - F.col("south")) * G.EARTH_M
    return rows.select(F.format_string("r%03dc%03d", "row", "col").alias("cell_id"), "row", "col", F.col("clat").alias("lat"), F.col("clng").alias("lng"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), ring.alias("ring"))


def clipped(boundary: DataFrame, points: DataFrame, km: float = CELL_KM) -> DataFrame:
    """`cells` of the boundary's extent whose centre lies in it, lat and lng of 6 digits; without a boundary, or if no centre lies
    in it, all cells of the points' extent.

    The boundary is one area's outline: its polygons are joined to the cells as a single row."""
    whole = boundary.agg(F.collect_list("rings").alias("polygons"))
    inside = cells(extent(boundary, points), km).crossJoin(whole).where((F.size("polygons") == 0) | in_polygons("lng", "lat", F.col("polygons"))).drop("polygons")
    some = inside.agg(F.count(F.lit(1)) > 0).scalar()
    out = inside.unionByName(cells(extent(None, points), km).where(~some))
    return out.withColumns({c: F.round(c, 6) for c in ("lat", "lng")})
