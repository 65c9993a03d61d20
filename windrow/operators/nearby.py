"""Joins by place: nearest features and features in reach, by nested boxes of space, and full pairings in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions import geo as G
from windrow.operators.tables import fresh

#: Metres of the box that holds every place, and how often it is halved: the smallest boxes have sides of 256 metres.
ROOT, DEEPEST = float(1 << 26), 18
#: Blocks of the one side of a full pairing.
BLOCKS = 64


def globe(lat="lat", lng="lng") -> list[Column]:
    """Earth-centred coordinates of a place, in metres."""
    lat, lng = F.radians(F.col(lat)), F.radians(F.col(lng))
    return [F.cos(lat) * F.cos(lng) * G.EARTH_M, F.cos(lat) * F.sin(lng) * G.EARTH_M, F.sin(lat) * G.EARTH_M]


def plane(lat: str, lng: str, origin: tuple[float, float]) -> list[Column]:
    """Metres east and north of an origin."""
    return list(G.projected(lat, lng, *origin))


def places(points: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    """The different places of points, columns `by` telling them apart: `n`, the number of their points, and further sums.

    What meets other features by place alone is worked out once a place, so that stations in one place don't make pairs."""
    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[x.alias(c) for c, x in sums.items()])


def _boxes(at: list[str], size: Column) -> Column:
    """The box of a place, as a struct of its numbers along each axis."""
    return F.struct(*[F.floor((F.col(c) + ROOT / 2) / size).alias(f"b{i}") for i, c in enumerate(at)])


def _side(level: Column | int) -> Column:
    return F.lit(ROOT) / F.pow(F.lit(2.0), level if isinstance(level, Column) else F.lit(level))


def _around(rows: DataFrame, box: str, axes: int) -> DataFrame:
    """rows once for each box that touches theirs, their own included."""
    (step,) = fresh(rows.columns, "step")
    shift = lambda i: (F.col(f"{box}.b{i}") + F.floor(F.col(step) / 3**i) % 3 - 1).alias(f"b{i}")
    each = rows.withColumn(step, F.explode(F.sequence(F.lit(0), F.lit(3**axes - 1))))
    return each.withColumn(box, F.struct(*[shift(i) for i in range(axes)])).drop(step)


def candidates(left: DataFrame, right: DataFrame, key: str, at: list[str], k: int = 1, deepest: int = DEEPEST, keys: list[str] | None = None) -> DataFrame:
    """Pairs of left's and right's columns (of different names, but for the coordinates `at` and the groups' `keys`, which both have
    and only left keeps), among which are, for each left row, its k nearest right rows of its group by the distance of the
    coordinates, and all others that are as near to within a tenth of the k-th's box.

    Boxes halve level by level. A left row takes the smallest of its boxes that holds k right rows, so that its k-th nearest
    is no farther than the box's diagonal; it then meets the rows of the boxes of twice that side around it, which reach
    farther than the diagonal. Boxes that hold k rows are counted level by level; nothing meets all of the other side, unless
    a row's half of the world is empty. Right rows are repeated level by level, which Spark's sizes of tables don't know of, so
    they are never broadcast. Rows without coordinates have no neighbours."""
    keys = keys or []
    level, box, found = fresh([*left.columns, *right.columns], "level", "box", "found")
    known = lambda df: df.where(" and ".join(f"`{c}` is not null" for c in at))
    left, right = known(left), known(right)
    levels = F.explode(F.sequence(F.lit(0), F.lit(deepest)))
    inside = lambda df, *own: df.withColumn(level, levels).select(*own, level, _boxes(at, _side(F.col(level))).alias(box))
    filled = inside(right, *keys).groupBy(*keys, level, box).agg(F.count(F.lit(1)).alias(found)).where(F.col(found) >= k).select(*keys, level, box)
    fits = inside(left, *keys, key).join(filled.hint("merge"), [*keys, level, box], "left_semi").groupBy(*keys, key).agg(F.max(level).alias(level))
    searched = left.join(fits.hint("merge"), [*keys, key], "left").withColumn(level, F.greatest(F.coalesce(F.col(level), F.lit(0)) - 1, F.lit(0)))
    met = _around(searched.withColumn(box, _boxes(at, _side(F.col(level)))), box, len(at))
    other = [c for c in right.columns if c not in [*at, *keys]]
    return met.join(inside(right, *keys, *other).hint("merge"), [*keys, level, box]).select(*left.columns, *other)


def within(left: DataFrame, right: DataFrame, at: list[str], metres: float | Column, keys: list[str] | None = None) -> DataFrame:
    """Pairs of left's and right's columns (of different names, but for the coordinates `at` and the groups' `keys`) of one group
    whose places are at most so far apart, with `apart`. They meet by boxes of that size, which may be a column that only the keys
    decide; the right rows are repeated in the boxes around theirs."""
    keys = keys or []
    box, size = fresh([*left.columns, *right.columns], "box", "size")
    to = {c: f"{c}_to" for c in at}
    metres = metres if isinstance(metres, Column) else F.lit(float(metres))
    far = _around(right.withColumn(box, _boxes(at, metres)), box, len(at)).select(box, *keys, *[F.col(c).alias(to.get(c, c)) for c in right.columns if c not in keys])
    pairs = left.withColumn(size, metres).withColumn(box, _boxes(at, F.col(size))).join(far.hint("merge"), [*keys, box])
    return pairs.withColumn("apart", F.sqrt(sum(F.pow(F.col(c) - F.col(to[c]), 2) for c in at))).where(F.col("apart") <= F.col(size)).drop(box, size, *to.values())


def paired(left: DataFrame, right: DataFrame, key: str, keys: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """Every row of left with every row of right of its group, for sums that need all: a join on blocks of left's rows, in each of
    which right is repeated, so that no side has to fit one task's memory. Given a number of tasks, Spark keeps to it; else it
    has fewer where the rows that meet are few, however many they make."""
    (block,) = fresh([*left.columns, *right.columns], "block")
    sides = left.withColumn(block, F.pmod(F.xxhash64(key), F.lit(BLOCKS)).cast("int")), right.withColumn(block, F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    rows, other = (df.repartition(tasks, *(keys or []), block) if tasks else df for df in sides)
    return rows.join(other.hint("merge"), [*(keys or []), block]).drop(block)


def smallest(points: DataFrame, at: list[str], k: int, key: str = "id") -> DataFrame:
    """Of the points in each place the k with the smallest ids."""
    (rank,) = fresh(points.columns, "rank")
    return points.withColumn(rank, F.row_number().over(Window.partitionBy(*at).orderBy(key))).where(F.col(rank) <= k).drop(rank)


def nearest(left: DataFrame, right: DataFrame, k: int = 1, columns: list[str] | None = None) -> DataFrame:
    """(id, other, metres, rank, columns of right): the k points of right next to each of left, itself left out; distances of 3
    digits, of equal ones the smaller id first. left's ids are different.

    Points in one place have the same distances, so each place is looked from once, for one more, and in each only the k + 1
    points of right with the smallest ids can be among the results."""
    c, columns = ["_x", "_y", "_z"], columns or []
    placed = lambda df, *own: df.select(*own, *[x.alias(n) for x, n in zip(globe(), c, strict=True)])
    given = {n: f"_r_{n}" for n in columns}
    others = smallest(right.select(F.col("id").alias("other"), "lat", "lng", *[F.col(n).alias(m) for n, m in given.items()]).where("lat is not null and lng is not null"), ["lat", "lng"], k + 1, "other")
    seen = left.where("lat is not null and lng is not null").groupBy("lat", "lng").agg(F.min("id").alias("_place"))
    pairs = candidates(placed(seen, "_place", "lat", "lng"), placed(others, "other", F.col("lat").alias("rlat"), F.col("lng").alias("rlng"), *given.values()), "_place", c, k + 1)
    far = pairs.select("lat", "lng", "other", F.round(G.haversine_m("lat", "lng", "rlat", "rlng"), 3).alias("metres"), *given.values())
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("metres", "other"))
    best = far.withColumn("rank", rank("lat", "lng")).where(F.col("rank") <= k + 1).drop("rank")
    own = left.select("id", "lat", "lng").join(best, ["lat", "lng"]).where("id <> other")
    return own.withColumn("rank", rank("id")).where(F.col("rank") <= k).select("id", "other", "metres", "rank", *[F.col(m).alias(n) for n, m in given.items()])
