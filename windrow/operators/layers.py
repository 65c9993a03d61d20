"""Map layers around cells and stations: segments, polygons, extents, contexts, hotspot influence, wind, variograms.

Nearest features and those in reach are met by boxes of space; only heights, of which every one counts, meet every cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions import geo as G
from windrow.functions import scalars as S
from windrow.operators import nearby as N
from windrow.operators.spatial import at_places, distances

RADIUS_M = 3000.0
REACH_M = 10_000.0
# fixed values: metres that a road of each category is wide
ROAD_WIDTHS = {"motorway": 18.0, "trunk": 14.0, "primary": 12.0, "secondary": 10.0, "tertiary": 8.0, "residential": 6.0, "service": 5.0}
OTHER_WIDTH = 6.0


def segments(lines: DataFrame, path: str = "path") -> DataFrame:
    """Each side of polylines (id, category, path of structs lat, lng) with its length."""
    n = F.greatest(F.size(path) - 1, F.lit(0))
    sides = F.arrays_zip(F.slice(path, 1, n).alias("p"), F.slice(path, 2, n).alias("q"))
    out = lines.select("id", "category", F.posexplode(sides).alias("i", "s"))
    ends = [F.col(f"s.{e}.{c}").alias(f"{c}{k}") for k, e in ((1, "p"), (2, "q")) for c in ("lat", "lng")]
    return out.select("id", "category", "i", *ends).withColumn("metres", G.haversine_m("lat1", "lng1", "lat2", "lng2"))


def line_length(path: str) -> Column:
    n = F.greatest(F.size(path) - 1, F.lit(0))
    sides = F.zip_with(F.slice(path, 1, n), F.slice(path, 2, n), lambda p, q: G.haversine_m(p["lat"], p["lng"], q["lat"], q["lng"]))
    return F.aggregate(sides, F.lit(0.0), lambda a, x: a + x)


def polygons(rows: DataFrame, ring: str, lat0: float, lng0: float) -> DataFrame:
    """rows with the area in square metres and the area-weighted centroid of a ring of structs (lat, lng)."""

    def metres(p):
        x, y = G.projected(p["lat"], p["lng"], lat0, lng0)
        return F.struct(x.alias("x"), y.alias("y"))

    flat = F.transform(ring, metres)
    cx, cy = G.ring_centroid(flat)
    return rows.withColumns({"area": G.ring_area(flat), "cx": cx, "cy": cy})


def extent(points: DataFrame, pad: float = 0.05) -> DataFrame:
    """One row: south, west, north, east of all points, padded."""
    return points.agg((F.min("lat") - pad).alias("south"), (F.min("lng") - pad).alias("west"), (F.max("lat") + pad).alias("north"), (F.max("lng") + pad).alias("east"))


def radius_samples(points: DataFrame, radius_m: float) -> DataFrame:
    """Each point and eight others around it at seven tenths of a radius."""
    around = points.select("id", "lat", "lng", F.explode(F.array(*[F.lit(x) for x in range(-45, 360, 45)])).alias("angle"))
    lat, lng = G.destination("lat", "lng", F.lit(0.7 * radius_m), F.col("angle"))
    own = F.col("angle") < 0
    return around.select("id", (F.col("angle") / 45 + 1).cast("long").alias("sample"), F.when(own, F.col("lat")).otherwise(lat).alias("lat"), F.when(own, F.col("lng")).otherwise(lng).alias("lng"))


def donated(points: DataFrame, references: DataFrame, columns: list[str]) -> DataFrame:
    """points (of different ids) with the columns of the nearest reference; of equally near ones the one with the smaller id."""
    return N.nearest(points, references, 1, columns).select("id", "metres", F.col("other").alias("reference"), *columns)


#: Degrees of the squares in which points meet the areas that reach into them.
SQUARE = 0.05


def inside(areas: DataFrame, points: DataFrame, ring: str = "ring") -> DataFrame:
    """(area, id) of the points inside each area's ring of structs (x = lng, y = lat).

    Areas meet points by the squares that their extent covers."""
    number = lambda x: F.floor(x / SQUARE)
    covered = [F.sequence(number(F.array_min(F.col(f"{ring}.{c}"))), number(F.array_max(F.col(f"{ring}.{c}")))) for c in "xy"]
    squares = areas.where(F.size(ring) > 0).select("area", ring, F.explode(covered[0]).alias("u"), covered[1].alias("vs")).select("area", ring, "u", F.explode("vs").alias("v"))
    at = points.select("id", "lat", "lng", number(F.col("lng")).alias("u"), number(F.col("lat")).alias("v"))
    return squares.join(at, ["u", "v"]).where(G.in_ring("lng", "lat", ring)).select("area", "id")


def members(areas: DataFrame, points: DataFrame, ring: str = "ring") -> DataFrame:
    """(area, members): ids of the points inside each area's ring, in order; none for areas without any."""
    met = inside(areas, points, ring).groupBy("area").agg(F.array_sort(F.collect_list("id")).alias("members"))
    none = F.array().cast(dict(met.dtypes)["members"])
    return areas.select("area").join(met, "area", "left").select("area", F.coalesce("members", none).alias("members"))


def _at(rows: DataFrame, lat0: float, lng0: float, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    made = {}
    for suffix, (lat, lng) in pairs.items():
        made[f"x{suffix}"], made[f"y{suffix}"] = G.projected(lat, lng, lat0, lng0)
    return rows.withColumns(made)


def _apart(x1: str, y1: str, x2, y2) -> Column:
    return F.sqrt(F.pow(F.col(x1) - S.col(x2), 2) + F.pow(F.col(y1) - S.col(y2), 2))


#: Roads are cut into pieces of so many metres where the nearest is looked for; the smallest boxes there have sides of 512.
PIECE_M, ROAD_DEPTH = 500.0, 17


def nearest_segment(points: DataFrame, sides: DataFrame, key: str) -> DataFrame:
    """(key, metres) from points (key, x, y) to the nearest of straight sides (x1, y1, x2, y2), wherever on it that is.

    Long sides are cut into pieces, which are found by their middles; the distance is the side's own."""
    n = F.greatest(F.ceil(F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)) / PIECE_M), F.lit(1))
    pieces = sides.select("x1", "y1", "x2", "y2", n.alias("n")).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    along = (F.col("i") - 0.5) / F.col("n")
    middles = pieces.select("x1", "y1", "x2", "y2", *[(F.col(f"{c}1") + along * (F.col(f"{c}2") - F.col(f"{c}1"))).alias(c) for c in "xy"])
    near = N.candidates(points.select(key, "x", "y"), middles, key, ["x", "y"], deepest=ROAD_DEPTH)
    return near.groupBy(key).agg(F.min(G.segment_distance("x", "y", "x1", "y1", "x2", "y2")).alias("metres"))


def cell_contexts(cells: DataFrame, roads: DataFrame, industries: DataFrame, greens: DataFrame, heights: DataFrame, origin: tuple[float, float], widths: dict[str, float] | None = None) -> DataFrame:
    """Of each cell (cell_id, lat, lng): the nearest road and industry; density of roads, green and sealed shares and
    industries within RADIUS_M; the proximity index; height and slope from inverse-distance weights.

    roads are segments, industries and heights points, greens points with an area. A layer without features gives nulls
    and no signal. Features count wholly where their middle is in the radius. Features in one place meet the cells once."""
    circle, own = F.lit(3.141592653589793 * RADIUS_M * RADIUS_M), cells.select("cell_id", "lat", "lng")
    at = ["x", "y"]
    c = _at(own, *origin, {"": ("lat", "lng")}).drop("lat", "lng")
    width = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i in (widths or ROAD_WIDTHS).items() for x in i]), F.col("category")), F.lit(OTHER_WIDTH))
    r = _at(roads, *origin, {"1": ("lat1", "lng1"), "2": ("lat2", "lng2")}).select("x1", "y1", "x2", "y2", width.alias("width"))
    r = N.places(r, r.columns).withColumn("length", _apart("x1", "y1", "x2", "y2"))
    middles = r.select(*[((F.col(f"{n}1") + F.col(f"{n}2")) / 2).alias(n) for n in at], (F.col("n") * F.col("length")).alias("length"), "width")
    placed = lambda points, *more: _at(points, *origin, {"": ("lat", "lng")}).select(*at, *more)
    places = N.places(placed(industries), at)
    nearest_place = N.candidates(c, places.select(F.col("x").alias("_px"), F.col("y").alias("_py")).select("*", F.col("_px").alias("x"), F.col("_py").alias("y")), "cell_id", at)

    def around(features: DataFrame, *aggregates) -> DataFrame:
        return N.within(c, features, at, RADIUS_M).groupBy("cell_id").agg(*aggregates)

    height = N.places(placed(heights, "height"), [*at, "height"]).withColumnsRenamed({"x": "xp", "y": "yp"})
    d = F.greatest(_apart("x", "y", "xp", "yp"), F.lit(1.0))
    mean = N.paired(c, height, "cell_id").withColumn("w", F.col("n") / F.pow(d, 2)).groupBy("cell_id").agg((F.sum(F.col("height") * F.col("w")) / F.sum("w")).alias("elevation"))
    slope = N.paired(c.join(mean, "cell_id"), height, "cell_id").withColumn("rise", F.abs(F.col("height") - F.col("elevation")) / d)
    slope = slope.groupBy("cell_id", "elevation").agg((F.sum(F.col("n") * F.col("rise")) / F.sum(F.when(F.col("rise").isNotNull(), F.col("n")))).alias("slope"))
    parts = (
        nearest_segment(c, r, "cell_id").withColumnRenamed("metres", "road_m"),
        around(middles, F.sum("length").alias("road_length"), F.sum(F.col("length") * F.col("width")).alias("road_area")),
        nearest_place.groupBy("cell_id").agg(F.min(_apart("x", "y", "_px", "_py")).alias("industry_m")),
        around(places, F.sum("n").alias("industries")),
        around(N.places(placed(greens, "area"), at, area=F.sum("area")), F.sum("area").alias("green_area")),
        slope,
    )
    out = own.select("cell_id")
    for part in parts:
        out = out.join(part, "cell_id", "left")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    density = zero(F.col("road_length")) / 1000 / (circle / 1_000_000)
    signal = lambda x: zero(F.greatest(F.lit(0.0), 1 - F.col(x) / 5000))
    return out.select(
        "cell_id",
        F.round("road_m", 2).alias("nearest_road_m"),
        F.round("industry_m", 2).alias("nearest_industry_m"),
        F.round(density, 4).alias("road_density"),
        F.round(F.least(F.lit(1.0), zero(F.col("green_area")) / circle), 4).alias("green_ratio"),
        F.round(F.least(F.lit(1.0), (zero(F.col("road_area")) + 400.0 * F.coalesce("industries", F.lit(0))) / circle), 4).alias("impervious_ratio"),
        F.coalesce("industries", F.lit(0)).cast("long").alias("industry_count"),
        F.round(0.45 * signal("road_m") + 0.35 * signal("industry_m") + 0.2 * F.least(density / 4, F.lit(1.0)), 4).alias("proximity_index"),
        F.round(zero(F.col("elevation")), 2).alias("elevation"),
        F.round(zero(F.col("slope")), 2).alias("slope"),
    )


def hotspot_component(cells: DataFrame, hotspots: DataFrame, radius_m: float | None = None) -> DataFrame:
    """(cell_id, component): inverse-distance mean of the strengths (z over 2.58, at most 1) of hotspots in reach."""
    hot = hotspots.where("z > 0").select(F.col("lat").alias("hlat"), F.col("lng").alias("hlng"), F.least(F.lit(1.0), F.col("z") / 2.58).alias("strength"))
    reach = max(radius_m or 0.0, REACH_M)
    far = hot.select("*", F.explode(G.cubes_around("hlat", "hlng", reach)).alias("cube"))
    near = cells.withColumn("cube", G.cube("lat", "lng", reach)).join(far, "cube").withColumn("d", F.greatest(G.haversine_m("lat", "lng", "hlat", "hlng"), F.lit(1.0))).where(F.col("d") <= reach)
    w = 1 / F.pow("d", F.lit(2))
    sums = near.groupBy("cell_id").agg((F.sum(F.col("strength") * w) / F.sum(w)).alias("component"))
    return cells.select("cell_id").join(sums, "cell_id", "left").select("cell_id", F.coalesce("component", F.lit(0.0)).alias("component"))


def wind_alignment(cells: DataFrame, industries: DataFrame, wind_from: float | None) -> DataFrame:
    """(cell_id, industry, alignment): the nearest industry, and how straight the wind blows from it to the cell; 0 beyond
    REACH_M or without wind."""
    near = donated(cells.select(F.col("cell_id").alias("id"), "lat", "lng"), industries.select(F.concat(F.lit("i"), "id").alias("id"), "lat", "lng", F.col("id").alias("industry"), F.col("lat").alias("ilat"), F.col("lng").alias("ilng")), ["industry", "ilat", "ilng"])
    out = cells.join(near.withColumnRenamed("id", "cell_id"), "cell_id")
    towards = F.lit(((wind_from or 0.0) + 180.0) % 360.0)
    straight = F.greatest(F.lit(0.0), F.cos(F.radians(G.angular_difference(G.bearing("ilat", "ilng", "lat", "lng"), towards))))
    return out.select("cell_id", "industry", F.when((F.col("metres") <= REACH_M) & F.lit(wind_from is not None), straight).otherwise(0.0).alias("alignment"))


#: Metres of the bins in which a variogram's middle distance is looked for.
BIN_M = 64.0


def variogram(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, nugget, sill, range_m) of each group: the sill is the variance, the range 1.75 upper medians of the
    distances, between a kilometre and the largest; the nugget is a twentieth of the sill.

    Distances are those of places, each counted as often as stations of the two make pairs; the middle one is ordered only within
    its bin of distances."""
    d = distances(at_places(points, keys), keys).where("metres > 0").select(*keys, "metres", F.floor(F.col("metres") / BIN_M).alias("bin"), (F.col("va.n") * F.col("vb.n")).alias("pairs"))
    bins = d.groupBy(*keys, "bin").agg(F.sum("pairs").alias("own"), F.max("metres").alias("most"))
    every, to = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bin")
    found = bins.select(*keys, "bin", "own", F.sum("own").over(to).alias("upto"), F.max("most").over(every).alias("most"), (F.floor(F.sum("own").over(every) / 2) + 1).alias("i"))
    found = found.where("upto >= i and upto - own < i").select(*keys, "bin", "most", (F.col("i") - F.col("upto") + F.col("own")).alias("i"))
    within = Window.partitionBy(*keys).orderBy("metres").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    middle = d.join(found, [*keys, "bin"]).withColumn("upto", F.sum("pairs").over(within)).where("upto >= i").groupBy(*keys).agg(F.min("metres").alias("metres"), F.max("most").alias("most"))
    sill = points.groupBy(*keys).agg(F.greatest(F.coalesce(F.var_samp("value"), F.lit(0.0)), F.lit(1e-6)).alias("sill"))
    return sill.join(middle, keys).select(*keys, (0.05 * F.col("sill")).alias("nugget"), "sill", F.greatest(F.lit(1000.0), F.least("most", 1.75 * F.col("metres"))).alias("range_m"))


def buffers(points: DataFrame, features: DataFrame, radii: tuple[int, ...] = (250, 500, 1000)) -> DataFrame:
    """(id, radius, features, area): number and area of the features around each point within each radius, found once for points
    in one place and for features in one place."""
    far = float(max(radii))
    known = N.places(features.where("lat is not null and lng is not null").select(F.col("lat").alias("flat"), F.col("lng").alias("flng"), "area"), ["flat", "flng"], area=F.sum("area"))
    around = known.select("*", F.explode(G.cubes_around("flat", "flng", far)).alias("cube"))
    near = points.select("lat", "lng").distinct().withColumn("cube", G.cube("lat", "lng", far)).join(around.hint("merge"), "cube").withColumn("d", G.haversine_m("lat", "lng", "flat", "flng")).where(F.col("d") <= far)
    inside = near.withColumn("radius", F.explode(F.array(*map(F.lit, radii)))).where(F.col("d") <= F.col("radius"))
    sums = inside.groupBy("lat", "lng", "radius").agg(F.sum("n").alias("features"), F.sum("area").alias("area"))
    each = points.select("id", "lat", "lng", F.explode(F.array(*map(F.lit, radii))).alias("radius"))
    return each.join(sums, ["lat", "lng", "radius"], "left").select("id", "radius", "features", "area").fillna({"features": 0, "area": 0.0})


#: Radii of the surroundings of stations.
BUFFERS = (250, 500, 1000)


def road_features(sides: DataFrame) -> DataFrame:
    """Sides of roads (category, lat1, lng1, lat2, lng2, metres) as features of `station_buffers`, each at its middle."""
    width = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i in ROAD_WIDTHS.items() for x in i]), F.col("category")), F.lit(OTHER_WIDTH))
    middle = [((F.col(f"{c}1") + F.col(f"{c}2")) / 2).alias(c) for c in ("lat", "lng")]
    return sides.select(F.lit("road").alias("kind"), *middle, (F.col("metres") * width).alias("area"), F.col("metres").alias("length"))


def station_buffers(stations: DataFrame, features: DataFrame, heights: DataFrame, radii: tuple[int, ...] = BUFFERS) -> DataFrame:
    """(id, radius, building_density, road_density, green_ratio, impervious_ratio, industry_count, mean_elevation, slope_mean) around
    each station (id, lat, lng) for each radius.

    features are (kind, lat, lng, area, length): buildings, greens and industries (kind building, green, industry; at their centroid
    with an area, or industries at a point without one) and sides of roads (`road_features`). One join by boxes of the largest
    radius finds those in reach, once for stations in one place and for features of a kind in one place; each counts in the smallest radius that it is in, and larger radii are sums of smaller ones.
    heights are (id, radius, sample, elevation) of `radius_samples`, sample 0 the station's own: their mean, and the mean slope to the
    others, at seven tenths of the radius. What isn't there counts as 0; without heights they are null."""
    far = float(max(radii))
    at = ["_x", "_y", "_z"]
    globe = lambda lat, lng: [x.alias(n) for x, n in zip(N.globe(lat, lng), at, strict=True)]
    own = stations.select("lat", "lng").distinct().select("lat", "lng", *globe("lat", "lng"))
    others = N.places(features, ["kind", "lat", "lng"], area=F.coalesce(F.sum("area"), F.lit(0.0)), length=F.coalesce(F.sum("length"), F.lit(0.0)))
    others = others.select("kind", "n", F.col("lat").alias("flat"), F.col("lng").alias("flng"), "area", "length", *globe("lat", "lng"))
    d = G.haversine_m("lat", "lng", "flat", "flng")
    near = N.within(own, others, at, far).withColumn("d", d)
    ring = F.coalesce(*[F.when(F.col("d") <= r, r) for r in sorted(radii)])
    kinds = ("building", "green", "industry", "road")
    area = [F.sum(F.when(F.col("kind") == k, F.col("area")).otherwise(0.0)).alias(k) for k in kinds]
    rings = near.withColumn("radius", ring).where("radius is not null").groupBy("lat", "lng", "radius").agg(*area, F.sum("length").alias("length"), F.sum(F.when(F.col("kind") == "industry", F.col("n")).otherwise(0)).alias("industries"))
    each = stations.select("id", "lat", "lng", F.explode(F.array(*map(F.lit, sorted(radii)))).alias("radius")).join(rings, ["lat", "lng", "radius"], "left")
    to = Window.partitionBy("id").orderBy("radius").rowsBetween(Window.unboundedPreceding, 0)
    sums = each.select("id", "radius", *[F.coalesce(F.sum(c).over(to), F.lit(0.0)).alias(c) for c in (*kinds, "length")], F.coalesce(F.sum("industries").over(to), F.lit(0)).cast("long").alias("industries"))
    base = F.max(F.when(F.col("sample") == 0, F.col("elevation"))).over(Window.partitionBy("id", "radius"))
    slope = F.when(F.col("sample") > 0, F.degrees(F.atan(F.abs(F.col("elevation") - F.col("base")) / (F.col("radius") * 0.7))))
    relief = heights.withColumn("base", base).groupBy("id", "radius").agg(F.avg("elevation").alias("mean"), F.coalesce(F.avg(slope), F.lit(0.0)).alias("slope"))
    circle = F.lit(3.141592653589793) * F.col("radius") * F.col("radius")
    share = lambda x: F.round(F.least(F.lit(1.0), x / circle), 4)
    return sums.join(relief, ["id", "radius"], "left").select(
        "id",
        F.col("radius").cast("long").alias("radius"),
        F.round(F.col("building") / circle, 4).alias("building_density"),
        F.round(F.col("length") / 1000 / (circle / 1_000_000), 4).alias("road_density"),
        share(F.col("green")).alias("green_ratio"),
        share(F.col("building") + F.col("industry") + F.col("road")).alias("impervious_ratio"),
        F.col("industries").alias("industry_count"),
        F.round("mean", 2).alias("mean_elevation"),
        F.round("slope", 2).alias("slope_mean"),
    )
