"""Windows of text that occur more than once in a corpus: what the suffix-array and suffix-tree operators share.

Every window of `window` units (bytes or words) has an anchor, the least of the hashed runs of `anchor` units inside it
(Schleimer et al., 2003). Equal windows have equal anchors, so the suffixes that start windows are split into groups by
the prefix that ends with their anchor; prefixes that end with the same anchor share a group. A group that is too large is
split by longer prefixes, up to the whole window.

1. Each document's anchors, with the stretch of windows that share one, are dealt by anchor. Stretches that are equal as
   a whole are one row with a count from there on (in each task before they are dealt, then over all), and an anchor with
   one stretch is no repeat. Anchors that hold a noticeable share of all stretches are found first, by a count over all
   documents, and are dealt by whole windows instead.
2. Where stretches with one anchor differ, their texts are fetched; the suffixes that start their windows are sorted by
   prefix doubling, with the common prefixes of neighbours in that order.
3. The operator's own structure over the suffix order (longest previous factors, or internal nodes) says what repeats.

Only positions near anchors that occur twice are ever sorted, and every stage streams: a task holds one group, or a few
small ones, at a time. Equality of stretches in step 1 is by 144 bits of hash (64 of the anchor, 80 of the stretch's XXH3),
of suffixes in step 2 by their text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, hashed, mixed, with_uid, words, written

BLOCK = 2_000_000
#: Stretches that a task combines at a time.
COMBINED = 1_000_000
#: Bytes of rows, or of text, that a task works on at a time, but for a key that has more by itself.
HELD, SORTED = 16_000_000, 1_000_000
#: An anchor with this share of all stretches is hot; there are at most 2 / HOT of them, which are sent to every task.
HOT = 1e-5
#: A hash's multiplier and its inverse modulo 2^64.
M = 0x9E3779B97F4A7C15
M_INVERSE = pow(M, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        _powers[base] = np.cumprod(x)
    return _powers[base][:n]


#: From the suffix order of a group (places of the suffixes, common prefixes with the one before, depth) to which repeat.
Rule = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


@dataclass(frozen=True)
class Units:
    """What windows consist of. earlier: mark only windows that also start earlier, instead of all that occur twice.

    Anchors with more than `split` different stretches are split by whole windows; a text is scanned in pieces of `piece`
    units, which overlap by a window, so its length has no bound but Spark's own."""

    kind: str
    window: int
    anchor: int
    earlier: bool
    split: int = 4096
    piece: int = 1 << 22

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, bytes]:
        """(units, starts, data): 64-bit values that stand for the units, where each text's begin, and bytes to compare."""
        if self.kind == "words":
            w = words(texts)
            units = hashed(w.vocab)[w.codes] if len(w.codes) else np.zeros(0, np.uint64)
            return units, w.starts, units.tobytes()
        raw = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
        starts = np.concatenate([[0], np.cumsum(pc.binary_length(raw).to_numpy(zero_copy_only=False))]).astype(np.int64)
        data = b"".join(raw.to_pylist())
        return mixed(np.arange(1, 257))[np.frombuffer(data, np.uint8)], starts, data

    @property
    def size(self) -> int:
        """Bytes of `data` that a unit has."""
        return 1 if self.kind == "bytes" else 8

    def cut(self, text: bytes) -> list[bytes] | bytes:
        return text if self.kind == "bytes" else text.split()

    def joined(self, own: list[bytes] | bytes) -> bytes:
        return own if self.kind == "bytes" else b" ".join(own)

    def codes(self, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(codes, lengths) of a group's texts: equal units, and only these, have equal codes."""
        if self.kind == "bytes":
            return np.frombuffer(b"".join(contexts), np.uint8), np.array([len(c) for c in contexts])
        lists = [c.split(b" ") for c in contexts]
        coded = pa.array([w for own in lists for w in own], pa.binary()).dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.array([len(x) for x in lists])


def digests(data: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """XXH3 of data[a:b], as two unsigned longs each."""
    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(data[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)


def stretches(units: np.ndarray, starts: np.ndarray, u: Units) -> tuple[np.ndarray, ...]:
    """(row, lo, n, a, c): windows lo, ..., lo + n of a row have one anchor, which a hashes; lo counts from the row's start.
    c is a quick hash of the whole stretch, for counts only."""
    ends = np.repeat(starts[1:], np.diff(starts))
    parts = [_stretches(units, ends, u, at) for at in range(0, max(0, len(units) - u.window + 1), u.piece)]
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    lo, n, a, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    row = np.searchsorted(starts, lo, side="right") - 1
    return row, lo - starts[row], n, a, c


def _stretches(units: np.ndarray, ends: np.ndarray, u: Units, first: int) -> tuple[np.ndarray, ...]:
    """The stretches of one piece: windows that start in [first, first + u.piece)."""
    units = units[first : first + u.piece + u.window - 1]
    n, position = len(units), np.uint64((1 << 24) - 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(units * powers(M, n), out=sums[1:])
        inverse = powers(M_INVERSE, n)
        grams = mixed((sums[u.anchor :] - sums[: -u.anchor]) * inverse[: n - u.anchor + 1])
    # the least gram and, of equal ones, the first: a piece has fewer than 2^24 positions
    least = (grams & ~position) | np.arange(len(grams), dtype=np.uint64)
    wide, span = u.window - u.anchor + 1, 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: span - wide], least[wide - span :])
    at = (least & position).astype(np.int64)
    valid = np.flatnonzero(first + np.arange(len(at)) + u.window <= ends[first : first + len(at)])
    if not len(valid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    own = at[valid]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(valid) != 1)]))
    lo, hi = valid[new], valid[np.append(new[1:], len(valid)) - 1]
    with np.errstate(over="ignore"):
        whole = mixed((sums[hi + u.window] - sums[lo]) * inverse[lo])
    return lo + first, hi - lo, grams[own[new]], whole


#: key (of the dealing), cls (64 bits of the stretch's hash; of a mark its further windows), uid, and a place: lo, the
#: further windows, a count and 16 more bits of the hash.
ROW = pa.schema([("key", pa.int64()), ("cls", pa.int64()), ("uid", pa.int64()), ("place", pa.int64())])
MARK, ONE, MANY = 0, 1, 2


def _place(lo: np.ndarray, n: np.ndarray, count: np.ndarray, more: np.ndarray) -> np.ndarray:
    parts = [x.astype(np.uint64) << np.uint64(s) for x, s in ((lo, 32), (n, 18), (count, 16))]
    return parts[0] | parts[1] | parts[2] | (more & np.uint64(0xFFFF))


def _lo(place: np.ndarray) -> np.ndarray:
    return (place >> np.uint64(32)).astype(np.int64)


def _n(place: np.ndarray) -> np.ndarray:
    return ((place >> np.uint64(18)) & np.uint64(0x3FFF)).astype(np.int64)


def _count(place: np.ndarray) -> np.ndarray:
    return ((place >> np.uint64(16)) & np.uint64(3)).astype(np.int64)


def _settled(key, cls, uid, place, earlier: bool):
    """Rows in order of key and stretch with (first of its class, to be marked, number of its key's classes)."""
    if len(key) > 1 and not ((uid[1:] > uid[:-1]) | ((uid[1:] == uid[:-1]) & (place[1:] >= place[:-1]))).all():
        order = np.lexsort((place, uid))
        key, cls, uid, place = key[order], cls[order], uid[order], place[order]
    order = np.lexsort((cls, key))
    key, cls, uid, place = key[order], cls[order], uid[order], place[order]
    if not len(key):
        return key, cls, uid, place, np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, np.int64)
    more = place & np.uint64(0xFFFF)
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    first = new_key | np.concatenate([[True], (cls[1:] != cls[:-1]) | (more[1:] != more[:-1])])
    of = np.cumsum(first) - 1
    total = np.bincount(of, _count(place))
    mark = ~first if earlier else total[of] > 1
    classes = np.bincount(np.cumsum(new_key) - 1, first)[np.cumsum(new_key) - 1].astype(np.int64)
    return key, cls, uid, place, first, mark, classes


def _runs(uid: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks (uid, lo, n) of one document that touch, joined."""
    if not len(uid):
        return uid, lo, n
    order = np.lexsort((lo, uid))
    uid, lo, n = uid[order], lo[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (uid[1:] != uid[:-1]) | (lo[1:] != lo[:-1] + n[:-1] + 1)]))
    last = np.append(new[1:], len(uid)) - 1
    return uid[new], lo[new], lo[last] + n[last] - lo[new]


def _combined(parts: list[tuple], earlier: bool) -> pa.RecordBatch:
    """One row for each class of a task's stretches, and joined marks for what is settled already."""
    key, cls, uid, place, first, mark, _ = _settled(*(np.concatenate(x) for x in zip(*parts, strict=True)), earlier)
    of = np.cumsum(first) - 1
    keep = np.flatnonzero(first)
    count = np.minimum(2, np.bincount(of))[of[keep]] if len(of) else of
    own = place[keep]
    u2, l2, n2 = _runs(uid[mark], _lo(place[mark]), _n(place[mark]))
    scattered = mixed(u2.astype(np.uint64) * np.uint64(M) + l2.astype(np.uint64))
    zero = np.zeros(len(u2), np.uint64)
    columns = (
        np.concatenate([key[keep], scattered]).view(np.int64),
        np.concatenate([cls[keep].view(np.int64), n2]),
        np.concatenate([uid[keep], u2]),
        np.concatenate([_place(_lo(own), _n(own), count, own), _place(l2, zero, zero, zero)]).view(np.int64),
    )
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=ROW)


def _windows(data: bytes, uid: np.ndarray, lo: np.ndarray, n: np.ndarray, base: np.ndarray, u: Units) -> tuple:
    """Rows for each single window of stretches, whose key and class hash the whole window; base: where the row's data begins."""
    i = np.repeat(np.arange(len(lo)), n + 1)
    at = lo[i] + np.arange(len(i)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
    a = (base[i] + at) * u.size
    d = digests(data, a, a + u.window * u.size)
    one = np.ones(len(i), np.uint64)
    return d[:, 0], d[:, 1], uid[i], _place(at, 0 * one, one, 0 * one)


def _scan(u: Units, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for block in blocks(batches, "text", BLOCK):
            units, starts, data = u.of(block.column("text"))
            row, lo, n, a, _ = stretches(units, starts, u)
            uid, base = block.column("uid").to_numpy(zero_copy_only=False)[row], starts[row]
            if len(hot):
                is_hot = hot[np.minimum(np.searchsorted(hot, a), len(hot) - 1)] == a
                parts.append(_windows(data, uid[is_hot], lo[is_hot], n[is_hot], base[is_hot], u))
                held += len(parts[-1][0])
                uid, base, lo, n, a = (x[~is_hot] for x in (uid, base, lo, n, a))
            d = digests(data, (base + lo) * u.size, (base + lo + n + u.window) * u.size)
            parts.append((a, d[:, 0], uid, _place(lo, n, np.ones(len(n), np.uint64), d[:, 1])))
            held += len(lo)
            if held >= COMBINED:
                yield _combined(parts, u.earlier)
                parts, held = [], 0
        if parts:
            yield _combined(parts, u.earlier)

    return run


def hot_anchors(docs: DataFrame, u: Units, share: float | None = None) -> np.ndarray:
    """Anchors with about `share` or more of all different stretches of docs (uid, text), in order; at most 2 / share.

    Each task reports the anchors that have at least half the share of its own stretches: an anchor with the share of all
    has at least half its stretches in tasks that report it. Only the way of the dealing depends on it, no result."""
    share = HOT if share is None else share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, parts, held = 0, [], 0
        key, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for block in blocks(batches, "text", BLOCK):
            *_, a, c = stretches(*u.of(block.column("text"))[:2], u)
            parts.append((a, c))
            total, held = total + len(a), held + len(a)
            if held > COMBINED:
                key, count = _counted(parts, key, count, share * total / 16)
                parts, held = [], 0
        key, count = _counted(parts, key, count, share * total / 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(key.view(np.int64), 0)), pa.array(np.append(count, total)), pa.array(np.arange(len(key) + 1) == len(key))], ["key", "n", "every"])

    sums = docs.select("uid", "text").mapInArrow(run, "key long, n long, every boolean").groupBy("key", "every").agg(F.sum("n").alias("n"))
    sums = written(sums, "anchors")
    total = sums.where("every").agg(F.sum("n")).first()[0] or 0
    rows = sums.where(~F.col("every") & (F.col("n") >= F.lit(max(share * total / 2, float(u.split))))).select("key").toArrow()  # bounded by 2 / share
    return np.sort(rows.column("key").to_numpy().astype(np.int64).view(np.uint64))


def _counted(parts: list[tuple], key: np.ndarray, count: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Counts so far and those of parts (anchor, stretch), equal stretches once; only counts that may still matter stay."""
    a, c = (np.concatenate([*x, np.zeros(0, np.uint64)]) for x in (zip(*parts, strict=True) if parts else ((), ())))
    with np.errstate(over="ignore"):
        a = a[np.unique(a * np.uint64(M) + c, return_index=True)[1]]
    own, n = np.unique(a, return_counts=True)
    both, back = np.unique(np.concatenate([key, own]), return_inverse=True)
    total = np.bincount(back, np.concatenate([count, n]), len(both)).astype(np.int64)
    keep = total >= max(2, least)
    return both[keep], total[keep]


def whole_keys(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of whole keys and about `most` bytes, from rows in order of key."""
    held, size, enough = [], 0, most
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= enough:
            rows = pa.Table.from_batches(held)
            key = rows.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield rows.slice(0, last).combine_chunks()
                held = rows.slice(last).combine_chunks().to_batches()
                size, enough = sum(x.nbytes for x in held), most
            enough = max(enough, 2 * size)
    if held:
        rows = pa.Table.from_batches(held)
        if rows.num_rows:
            yield rows.combine_chunks()


def _columns(rows: pa.Table) -> tuple[np.ndarray, ...]:
    key, cls, uid, place = (rows.column(c).to_numpy() for c in ROW.names)
    return key.view(np.uint64), cls.view(np.uint64), uid, place.view(np.uint64)


FOUND = pa.schema([("uid", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("split", pa.bool_())])


def _settle(u: Units):
    """Of all stretches with a key: those to be marked (key null), and the first of each class if there are several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches, HELD):
            key, cls, uid, place = _columns(rows)
            done = _count(place) == MARK
            k2, _, u2, p2, first, mark, classes = _settled(*(x[~done] for x in (key, cls, uid, place)), u.earlier)
            ask = np.flatnonzero(first & (classes > 1))
            mu, ml, mn = _runs(u2[mark], _lo(p2[mark]), _n(p2[mark]))
            mu, ml, mn = np.concatenate([uid[done], mu]), np.concatenate([_lo(place[done]), ml]), np.concatenate([cls[done].view(np.int64), mn])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([mu, u2[ask]])),
                    pa.array(np.concatenate([ml, _lo(p2[ask])])),
                    pa.array(np.concatenate([mn, _n(p2[ask])])),
                    pa.array(np.concatenate([np.zeros(len(mu), np.int64), k2[ask].view(np.int64)]), mask=np.arange(len(mu) + len(ask)) < len(mu)),
                    pa.array(np.concatenate([np.zeros(len(mu), bool), classes[ask] > u.split])),
                ],
                schema=FOUND,
            )

    return run


CONTEXT = pa.schema([*ROW, ("units", pa.binary())])


def _fetch(u: Units):
    """The texts of asked stretches, or where their key is split a row for each window instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            out, single = [], []
            for uid, z, asked in zip(*(batch.column(c).to_pylist() for c in ("uid", "z", "asked")), strict=True):
                text = unzip.decompress(z)
                own = u.cut(text)
                for x in asked:
                    if not x["split"]:
                        out.append((x["key"], 0, uid, x["lo"] << 32, u.joined(own[x["lo"] : x["lo"] + x["n"] + u.window])))
                lo, n = (np.array([x[c] for x in asked if x["split"]], np.int64) for c in ("lo", "n"))
                if len(lo):
                    data = u.of(pa.array([text.decode()]))[2]
                    single.append(_windows(data, np.full(len(lo), uid), lo, n, np.zeros(len(lo), np.int64), u))
            if single:
                some = _combined(single, u.earlier)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.nulls(some.num_rows, pa.binary())], schema=CONTEXT)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), CONTEXT.types, strict=True)], schema=CONTEXT)

    return run


def suffix_ranks(units: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(span, rank) for growing spans, the last one `depth`: the rank of each suffix among all by its first `span` units,
    by prefix doubling; equal prefixes, and only these, rank equally.

    Suffixes shorter than a span have the rank of what is there to compare, which callers must not use."""
    span, levels = 1, []
    if units.dtype == np.uint8 and depth >= 8:  # eight bytes fit one value
        levels.append((1, units))
        padded, span = np.concatenate([units, np.zeros(7, np.uint8)]).astype(np.uint64), 8
        units = np.bitwise_or.reduce([padded[j : j + len(units)] << np.uint64(56 - 8 * j) for j in range(8)])
    rank = np.unique(units, return_inverse=True)[1].astype(np.int64)
    levels.append((span, rank))
    while span < depth:
        step = min(span, depth - span)
        pair = rank * (int(rank.max(initial=0)) + 2)
        pair[: len(rank) - step] += rank[step:] + 1
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        span += step
        levels.append((span, rank))
    return levels


def common_prefixes(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """How many units the suffixes at a and at b have in common, up to depth."""
    size = len(levels[0][1])
    out = np.where(levels[-1][1][a] == levels[-1][1][b], depth, 0)
    part = np.flatnonzero(out < depth)
    for span, rank in levels[-2::-1]:
        while len(part):
            x, y = a[part] + out[part], b[part] + out[part]
            inside = (x < size) & (y < size)
            same = part[inside][rank[x[inside]] == rank[y[inside]]]
            out[same] = np.minimum(out[same] + span, depth)
            if span > 1 or not len(same):
                break
            part = same
    return out


def smaller_before(values: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at, common): for each entry the nearest one before it with a smaller value (-1: none), and the least of lcp between.

    lcp[i] belongs to entries i - 1 and i. Entries that are not smaller are skipped together with all they skipped
    themselves, so the rounds are few."""
    at, common = np.arange(len(values)) - 1, lcp.copy()
    open_ = np.arange(len(values))
    while len(open_):
        near = at[open_]
        open_ = open_[(near >= 0) & (values[near] >= values[open_])]
        skip = at[open_]
        common[open_] = np.minimum(common[open_], common[skip])
        at[open_] = at[skip]
    common[at < 0] = 0
    return at, common


def smaller_after(values: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As smaller_before, for the nearest smaller one after each entry (the number of entries: none)."""
    back = np.concatenate([[0], lcp[:0:-1]]).astype(lcp.dtype) if len(lcp) else lcp
    at, common = smaller_before(values[::-1], back)
    return len(values) - 1 - at[::-1], common[::-1]


def _marked(rows: pa.Table, u: Units, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uid, lo, n) of the runs of windows in rows' stretches that the suffix order shows to be repeats."""
    units, length = u.codes(rows.column("units").to_pylist())
    starts, n = np.cumsum(length) - length, length - u.window + 1
    row = np.repeat(np.arange(len(n)), n)
    off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    levels, at = suffix_ranks(units, u.window), starts[row] + off
    uid, lo = rows.column("uid").to_numpy()[row], _lo(rows.column("place").to_numpy().view(np.uint64))[row] + off
    place = np.zeros(len(at), np.int64)
    place[np.lexsort((lo, uid))] = np.arange(len(at))
    order = np.lexsort((place, levels[-1][1][at]))
    lcp = np.zeros(len(at), np.int64)
    lcp[1:] = common_prefixes(levels, at[order][:-1], at[order][1:], u.window)
    hit = np.sort(order[rule(place[order], lcp, u.window)])
    if not len(hit):
        return hit, hit, hit
    new = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(row[hit]) != 0)]))
    last = hit[np.append(new[1:], len(hit)) - 1]
    return uid[hit[new]], lo[hit[new]], last - hit[new]


def _sort_suffixes(u: Units, rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches, SORTED):
            has = rows.column("units").is_valid()
            out = []
            single = rows.filter(pc.invert(has))
            if single.num_rows:  # groups whose prefix is a whole window
                key, cls, uid, place = _columns(single)
                done = _count(place) == MARK
                _, _, u2, p2, _, mark, _ = _settled(*(x[~done] for x in (key, cls, uid, place)), u.earlier)
                out += [(uid[done], _lo(place[done]), cls[done].view(np.int64)), _runs(u2[mark], _lo(p2[mark]), _n(p2[mark]))]
            texts = rows.filter(has)
            if texts.num_rows:
                out.append(_marked(texts, u, rule))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["uid", "lo", "n"])

    return run


def _zipped(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, z): texts compressed for the way, a null text as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = [zip_.compress((t or "").encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), pa.array(z, pa.binary())], ["uid", "doc_id", "z"])

    return docs.mapInArrow(run, "uid long, doc_id long, z binary")


def without_repeats(docs: DataFrame, u: Units, rule: Rule, drop: Callable[[bytes, np.ndarray], tuple[int, bytes]]) -> DataFrame:
    """(doc_id, n_units, n_removed, spans, kept): spans are the maximal runs of removed units, [start, end).

    rule reads the repeats off a group's suffix order; drop(text, removed) gives the number of units of a text and what
    stays of it."""
    docs = with_uid(docs)
    rows = docs.select("uid", "text").mapInArrow(_scan(u, hot_anchors(docs, u)), "key long, cls long, uid long, place long")
    found = written(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_settle(u), "uid long, lo long, n long, key long, split boolean"), "stretches")
    zipped = _zipped(docs)
    asked = found.where("key is not null").groupBy("uid").agg(F.collect_list(F.struct("key", "lo", "n", "split")).alias("asked"))
    # doc_id goes along so that both joins read one exchange of the texts
    contexts = zipped.join(asked, "uid").mapInArrow(_fetch(u), "key long, cls long, uid long, place long, units binary")
    sorted_ = contexts.repartition("key").sortWithinPartitions("key").mapInArrow(_sort_suffixes(u, rule), "uid long, lo long, n long")
    marks = found.where("key is null").select("uid", "lo", "n").unionByName(sorted_)
    per = marks.groupBy("uid").agg(F.collect_list(F.shiftleft("lo", 32).bitwiseOR(F.col("n"))).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for z, marks in zip(b.column("z").to_pylist(), b.column("marks").to_pylist(), strict=True):
                text = unzip.decompress(z)
                edge = np.zeros(len(text) + u.window + 1, np.int32)
                if marks:
                    m = np.array(marks, np.int64)
                    np.add.at(edge, m >> 32, 1)
                    np.add.at(edge, (m >> 32) + (m & 0xFFFFFFFF) + u.window, -1)
                removed = np.cumsum(edge) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[False], removed, [False]]).astype(np.int8)))
                n, kept = drop(text, removed)
                spans = [{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)]
                out.append({"n_units": n, "n_removed": int(removed.sum()), "spans": spans, "kept": kept})
            own = pa.RecordBatch.from_pylist(out, schema=pa.schema([("n_units", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *own.columns], ["doc_id", *own.schema.names])

    schema = "doc_id long, n_units long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
    return zipped.join(per, "uid", "left").select("doc_id", "z", "marks").mapInArrow(run, schema)
