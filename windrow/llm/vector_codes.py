"""Vectors coded by their parts' nearest entries in learnt codebooks, with Elkan's bounds against most of the distances."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of one step in a task, and pairs of a part and an entry whose distances are taken at once.
BLOCK, PAIRS = 4096, 1 << 17
#: Lower bounds are kept in 16 bits.
MOST = (1 << 16) - 1


def floor_root(squares: np.ndarray) -> np.ndarray:
    """The integer square root of each integer under 2^63."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    return r + ((r + 1) * (r + 1) <= squares)


def ceil_root(squares: np.ndarray) -> np.ndarray:
    r = floor_root(squares)
    return r + (r * r < squares)


def squares_between(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c: by products of doubles where these hold every integer that occurs."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64
    a, b = x.astype(kind), c.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)


@dataclass
class Codebook:
    """Entries of one part, how far each has moved at most, and the unit in which lower bounds are kept."""

    entries: np.ndarray
    moved: np.ndarray
    unit: int

    def __post_init__(self) -> None:
        apart = squares_between(self.entries, self.entries)
        np.fill_diagonal(apart, np.iinfo(np.int64).max >> 2)
        self.apart = floor_root(apart)
        self.nearest = self.apart.min(axis=1)


@dataclass
class Bounds:
    """Of each vector's part: its entry, an upper bound of the distance to it, and lower bounds of those to every entry."""

    own: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def first_bounds(x: np.ndarray, book: Codebook) -> Bounds:
    """All distances are taken; of equally near entries the first is chosen."""
    squares = squares_between(x, book.entries)
    own = squares.argmin(axis=1)
    best = squares[np.arange(len(x)), own]
    return Bounds(own, ceil_root(best), np.minimum(floor_root(squares) // book.unit, MOST).astype(np.uint16))


def _distances(x: np.ndarray, book: Codebook, rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), PAIRS):
        gap = x[rows[at : at + PAIRS]] - book.entries[entries[at : at + PAIRS]]
        out[at : at + PAIRS] = np.einsum("ij,ij->i", gap, gap)
    return out


def next_bounds(x: np.ndarray, book: Codebook, held: Bounds) -> tuple[Bounds, int]:
    """The entries nearest to x after the codebook has moved, and how many distances that took.

    Bounds are shifted by the entries' movements, all rounded to the safe side. An entry is passed over only if a bound puts
    it strictly farther than the present one: its lower bound, or half the distance between both entries, is over the
    upper bound. All others are compared by squared distances in integers, equal ones by their index."""
    own = held.own.copy()
    upper = held.upper + book.moved[own]
    shift = -(-book.moved // book.unit)
    lower = np.maximum(held.lower.astype(np.int64) - shift, 0).astype(np.uint16)
    rows = np.flatnonzero(2 * upper >= book.nearest[own])
    best = _distances(x, book, rows, own[rows])
    taken = len(rows)
    upper[rows] = ceil_root(best)
    lower[rows, own[rows]] = np.minimum(floor_root(best) // book.unit, MOST)
    left = 2 * upper[rows] >= book.nearest[own[rows]]
    rows, best = rows[left], best[left]
    u, o = upper[rows][:, None], own[rows]
    open_ = (lower[rows].astype(np.int64) * book.unit <= u) & (book.apart[o] <= 2 * u)
    open_[np.arange(len(rows)), o] = False
    at, entry = np.nonzero(open_)
    found = _distances(x, book, rows[at], entry)
    lower[rows[at], entry] = np.minimum(floor_root(found) // book.unit, MOST)
    if len(at):
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        least = np.minimum.reduceat(found, starts)
        first = np.minimum.reduceat(np.where(found == np.repeat(least, np.diff(np.append(starts, len(at)))), entry, len(book.entries)), starts)
        to = at[starts]
        nearer = (least < best[to]) | ((least == best[to]) & (first < o[to]))
        own[rows[to[nearer]]] = first[nearer]
        upper[rows[to[nearer]]] = ceil_root(least[nearer])
    return Bounds(own, upper, lower), taken + len(at)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of an array as binary values."""
    rows = np.ascontiguousarray(rows)
    size = rows.strides[0] if len(rows) else 0
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _rows(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Binary values of one size as rows of an array."""
    raw = column.cast(pa.large_binary())
    start = int(np.frombuffer(raw.buffers()[1], np.int64)[raw.offset])
    return np.frombuffer(raw.buffers()[2], np.uint8)[start : start + len(raw) * width * np.dtype(kind).itemsize].view(kind).reshape(len(raw), width)


def largest_component(dims: int) -> int:
    """Components up to this size have squared distances, and sums of these over the parts, that fit 64 bits."""
    return isqrt((1 << 62) // max(dims, 1)) // 2


def _integers(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = pc.fill_null(pc.list_flatten(lists), float("nan")).to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore", over="ignore"):
                scaled = np.floor(values * scale)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            most = np.array([largest_component(s) for s in range(int(sizes.max(initial=0)) + 1)])[sizes]
            wrong = ~(np.isfinite(values) & (np.abs(scaled) <= np.repeat(most, sizes)))
            count = np.concatenate([[0], np.cumsum(wrong)])
            good = np.flatnonzero((sizes > 0) & (count[edges[1:]] == count[edges[:-1]]))
            whole = np.where(wrong, 0, scaled).astype("<i4")
            values = pa.array([whole[edges[i] : edges[i + 1]].tobytes() for i in good.tolist()], pa.binary())
            taken = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(taken), batch.column("label").take(taken), pa.array(sizes[good]), values], ["vec_id", "label", "dims", "vector"])

    return run


STATE = "vec_id long, label string, vector binary, code binary, upper binary, lower binary"
CODED = "vec_id long, label string, code string, error long"


def _assigner(books: list[Codebook], dims: int, first: bool, last: bool):
    parts, width, entries = len(books), dims // len(books), len(books[0].entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x = _rows(batch.column("vector"), "<i4", dims).astype(np.int64)
                own = [x[:, p * width : (p + 1) * width] for p in range(parts)]
                if first:
                    now = [first_bounds(a, b) for a, b in zip(own, books, strict=True)]
                else:
                    code = _rows(batch.column("code"), "u1", parts).astype(np.int64)
                    upper = _rows(batch.column("upper"), "<i8", parts)
                    lower = _rows(batch.column("lower"), "<u2", parts * entries).reshape(-1, parts, entries)
                    now = [next_bounds(own[p], books[p], Bounds(code[:, p], upper[:, p], lower[:, p]))[0] for p in range(parts)]
                codes = np.stack([b.own for b in now], axis=1).astype(np.uint8)
                if last:
                    every = np.arange(len(x))
                    errors = sum(_distances(own[p], books[p], every, now[p].own) for p in range(parts))
                    columns, names = [pa.array([c.hex() for c in map(bytes, codes)], pa.string()), pa.array(errors)], ["code", "error"]
                else:
                    uppers = np.stack([b.upper for b in now], axis=1).astype("<i8")
                    lowers = np.stack([b.lower for b in now], axis=1).astype("<u2").reshape(len(x), -1)
                    columns, names = [batch.column("vector"), _binary(codes), _binary(uppers), _binary(lowers)], ["vector", "code", "upper", "lower"]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *columns], ["vec_id", "label", *names])

    return run


def _summer(parts: int, entries: int, dims: int):
    """A task's sums of each entry's vectors: at most a row per entry and task."""
    width = dims // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in (b for b in batches if b.num_rows):
            x = _rows(batch.column("vector"), "<i4", dims)
            code = _rows(batch.column("code"), "u1", parts)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                starts = np.flatnonzero(np.append(True, np.diff(code[order, p]) != 0))
                at = p * entries + code[order[starts], p].astype(np.int64)
                sums[at] += np.add.reduceat(x[order, p * width : (p + 1) * width].astype(np.int64), starts, axis=0)
                counts[at] += np.diff(np.append(starts, len(order)))
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met]), *[pa.array(sums[met, i]) for i in range(width)]], ["entry", "n", *[f"s{i}" for i in range(width)]])

    return run


def _moved(state: DataFrame, books: list[Codebook], dims: int) -> list[Codebook]:
    """The codebooks with each entry at its vectors' mean, rounded down. The driver gets one row per entry."""
    parts, entries, width = len(books), len(books[0].entries), dims // len(books)
    fields = [f"s{i}" for i in range(width)]
    partial = state.select("vector", "code").mapInArrow(_summer(parts, entries, dims), ", ".join(f"{c} long" for c in ["entry", "n", *fields]))
    new = np.array([b.entries for b in books]).reshape(parts * entries, width)
    old = new.copy()
    for r in partial.groupBy("entry").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ["n", *fields]]).collect():
        new[r.entry] = [int(r[c]) // int(r.n) for c in fields]
    far = ceil_root(((new - old) ** 2).sum(axis=1))
    return [Codebook(new[p * entries : (p + 1) * entries], far[p * entries : (p + 1) * entries], books[p].unit) for p in range(parts)]


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of each vector in `embedding`, and the codebook of each part.

    Components become floor(scale * x), and vectors are cut into equal parts. Every part's codebook starts with the `entries`
    (256 at most) smallest vec_ids; each round assigns every part to its nearest entry, the first of equally near ones, and
    puts entries at the mean of their parts, rounded down; entries without parts stay. Then parts are assigned again.
    `code` has two hex digits for each part, `error` is the sum of the squared distances.

    Each round is one pass over a table that holds, for every vector, an upper bound for each part and a lower bound for
    each part and entry, in 16 bits (see `next_bounds`), and that takes the place of the one before; then sums of one row per
    task and entry give the new codebooks. Nothing else is shuffled, and tasks get the codebooks alone.

    Left out are vectors that are null or empty, hold a null, a NaN or an infinity, differ in length from the first kept
    vec_id's (the first whose length can be cut), or have a component so large that squared distances leave 64 bits
    (131072 for 64 dimensions at scale 1024). Repeated vec_ids are coded each, and of them the smaller vector comes first; null
    ones come last. Fewer vectors than entries make a smaller codebook; equal entries are never chosen but for the first.
    Other columns are not read. An empty table gives an empty result and no codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte: entries is 1 to 256")
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    whole = written(rows.mapInArrow(_integers(scale), "vec_id long, label string, dims long, vector binary"), "vectors")
    order = [F.col("vec_id").asc_nulls_last(), "vector"]
    first = whole.where(F.col("dims") % parts == 0).orderBy(*order).limit(1).collect()
    if not first:
        return spark.createDataFrame([], CODED), []
    dims = first[0].dims
    state = whole.where(F.col("dims") == dims)
    start = np.array([np.frombuffer(r.vector, "<i4") for r in state.orderBy(*order).limit(entries).collect()]).astype(np.int64)
    width = dims // parts
    spread = int(np.abs(start).max())
    unit = max(1, isqrt(4 * width * spread * spread) // MOST + 1)
    books = [Codebook(start[:, p * width : (p + 1) * width], np.zeros(len(start), np.int64), unit) for p in range(parts)]
    for step in range(rounds + 1):
        last = step == rounds
        state = written(state.mapInArrow(_assigner(books, dims, step == 0, last), CODED if last else STATE), "codes", instead_of=whole if step == 0 else state)
        if not last:
            books = _moved(state, books, dims)
    return state, [b.entries for b in books]


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error, the sum of error over rows of the same label, null labels together.

    The sums are written first: Spark sends them to the rows if they are small, else it splits what rows share a label."""
    key = F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))
    sums = written(codes.groupBy(key.alias("key")).agg(F.sum("error").alias("label_error")), "label-errors")
    return codes.withColumn("key", key).join(sums, "key").drop("key")


def query(spark, sf_dir: str) -> DataFrame:
    codes, books = coded(table(spark, sf_dir, "embeddings"))
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    steps = [
        """k as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        """p as materialized (
  select vec_id, part, x, list_inner_product(x, x) as xx
  from (select vec_id, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] as x from k, range(4) t(part)))""",
        """b0 as materialized (
  select part, e, x as c, xx as cc from (select *, row_number() over (partition by part order by vec_id) - 1 as e from p) where e < 256)""",
    ]
    for r in range(5):
        steps.append(f"""a{r} as materialized (
  select vec_id, part, min({{'d': xx + cc - 2 * list_inner_product(x, c), 'e': e}}) as best from p join b{r} using (part) group by all)""")
        if r < 4:
            steps.append(f"""m{r} as materialized (
  select part, e, list(m order by i) as c
  from (select part, best.e as e, i, floor(sum(x[i]) / count(*)) as m from a{r} join p using (vec_id, part), range(1, 65) t(i) where i <= len(x) group by all)
  group by all)""")
            steps.append(f"""b{r + 1} as materialized (
  select part, e, c, list_inner_product(c, c) as cc from (select part, e, coalesce(m{r}.c, b{r}.c) as c from b{r} left join m{r} using (part, e)))""")
    return f"""with {", ".join(steps)},
s as (select sha256(string_agg(array_to_string(list_transform(c, lambda x: x::bigint::varchar), ','), ',' order by part, e)) as codebooks_sha256 from b4),
f as (select vec_id, string_agg(printf('%02x', best.e), '' order by part) as code, sum(best.d)::bigint as error from a4 group by all)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from f join k using (vec_id), s"""


ORACLE = _oracle()
