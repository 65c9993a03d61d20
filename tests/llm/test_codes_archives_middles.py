"""Vector codes, WARC archives and fill-in-the-middle against plain versions, over odd rows and damaged archives."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from windrow.llm import fill_middle, vector_codes, warc

TEXT = "doc_id long, text string"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def texts(seed: int = 4) -> list:
    r = random.Random(seed)
    out = [None, "", " ", " \n\t ", "x", " x", "x ", "é", "\x1c  a　b", "a <P> b", "a <S>", "<M>", "ends <", "S> begins", "<<P", "\x00 \x00"]
    for _ in range(300):
        out.append("".join(r.choice(("ab", "ß", "語", "🙂", "é", " ", "  ", "\n", "\t", "\x0b", "\x85", "<", "S>", "x" * 9)) for _ in range(r.randint(0, 40))))
    return [*out, *out[:20], " ".join(f"w{i}é" for i in range(20_000)), "語" * 30_000, " " * 5_000]


def plain_middle(i, text: str) -> tuple:
    text = text or ""
    h = [int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = TOKEN.findall(text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return i, len(units), "plain", None, None, text
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return i, len(units), form, len(prefix), len(middle), out


@pytest.mark.parametrize("piece", [fill_middle.BLOCK_BYTES, 1000, 7])
def test_fill_in_middle(spark, piece):
    rows = [*enumerate(texts()), (3, "a repeated id"), (3, "a repeated id"), (None, "no id but a text"), (None, None)]
    docs = spark.createDataFrame(rows, TEXT).select("*", *[F.lit("own").alias(c) for c in ("n", "form", "h1", "output")])
    got = fill_middle.fill_in_middle(docs, piece=piece).withColumn("back", fill_middle.restored("form", "output")).collect()
    want = [(*plain_middle(i, t), t or "") for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_runs_of_a_long_text_in_pieces():
    r = random.Random(1)
    for _ in range(60):
        text = "".join(r.choice("a  \né語🙂") for _ in range(r.randint(1, 80)))
        data = np.frombuffer(text.encode(), np.uint8)
        h = np.array([[r.getrandbits(32)], [r.getrandbits(32)]])
        whole = fill_middle.cuts(data, np.array([0, len(data)]), h)
        parts = fill_middle.long_cuts(data, h, piece=r.randint(1, 9))
        units = TOKEN.findall(text)
        ends = ["".join(units[:k]) for k in sorted(x % (len(units) + 1) for x in h[:, 0].tolist())]
        for got in (whole, parts):
            assert got.n.tolist() == [len(units)]
            assert got.offsets[:, 0].tolist() == [len(e.encode()) for e in ends]
            assert got.chars[:, 0].tolist() == [len(e) for e in ends]


def test_marks_that_could_be_mistaken_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b")], TEXT)
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "<S<", "<M>"), ("<P>", "", "<M>"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError, match="marks"):
            fill_middle.fill_in_middle(docs, marks=marks)


def b32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


PAGES = [(i, f"http://h/{i} ü\r\nX: 1", t) for i, t in enumerate(texts()[:120])]
PAGES += [(900, None, "same"), (5, None, "same"), (-7, "u", "same"), (-7, "u", "same"), (None, "u", "same"), (None, None, None), (None, "u", "alone"), (2**62, "u", "x" * 70_000)]


def plain_pages(rows: list[tuple], least: int) -> list[tuple]:
    out = []
    for i, _, t in rows:
        payload = (t or "").encode()
        first = min((j for j, _, u in rows if (u or "").encode() == payload and j is not None), default=None)
        revisit = first is not None and first != i and len(payload) >= least
        out.append((i, len(payload), b32(payload), "revisit" if revisit else "response", first if revisit else None))
    return out


@pytest.mark.parametrize("gzip", [True, False])
@pytest.mark.parametrize("least", [0, 12])
def test_archives(spark, tmp_path, gzip, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").select("*", F.lit("own").alias("first"), F.lit("own").alias("digest")).repartition(3)
    path = f"{tmp_path}/archives"
    warc.write_archives(pages, path, least_bytes=least, gzip=gzip, records=50)
    found = warc.read_archives(spark, path)
    assert warc.quarantine(found).count() == 0
    got = warc.records(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_pages(PAGES, least), key=str)
    kept = {(r.page_id, r.payload.decode()) for r in found.where("record_type = 'response'").collect()}
    assert kept == {(i, t or "") for (i, _, t), w in zip(PAGES, plain_pages(PAGES, least), strict=True) if w[3] == "response"}
    empty = f"{tmp_path}/empty"
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_records_over_16_mb_are_several_members():
    payload = random.Random(2).randbytes(1 << 20) * 17
    whole = warc.member(warc.record(1, "u", payload))
    assert whole[-1] == 0 and warc.member(warc.record(2, "u", b"x"))[-1] == 0
    entries = list(warc.salvaged(whole + warc.member(warc.record(2, "u", b"x"))))
    assert [e.problem for e in entries] == [None, None] and entries[0].block.endswith(payload)
    cut = list(warc.salvaged(whole[:9_000_000] + warc.member(warc.record(2, "u", b"x"))))
    assert [bool(e.problem) for e in cut] == [True, False] and cut[1].fields["warc-record-id"] == warc.record_id(2)


@pytest.mark.parametrize("gzip", [True, False])
def test_salvage_of_damaged_archives(gzip):
    r = random.Random(int(gzip))
    for _ in range(150):
        records = [warc.record(i, "http://h/", ("word %d " % r.getrandbits(30)).encode() * r.randint(0, 60) + b"\n\x1f\x8b\x08 WARC/1.1\r\n" * r.randint(0, 1)) for i in range(12)]
        parts = [warc.member(x) if gzip else x for x in records]
        starts = np.cumsum([0, *map(len, parts)]).tolist()
        data, hurt = bytearray(b"".join(parts)), set()
        for _ in range(r.randint(0, 3)):  # bytes changed in place
            i = r.randrange(12)
            block = starts[i] + (10 if gzip else records[i].index(b"\r\n\r\n"))  # plain headers have no checksum
            at = r.randrange(block, starts[i + 1])
            data[at] ^= 1 << r.randrange(8)
            hurt.add(i)
        got = list(warc.salvaged(bytes(data)))
        ids = [warc.page_of(e.fields["warc-record-id"]) for e in got if not e.problem]
        assert {i for i in range(12) if i not in hurt} <= set(ids) and ids == sorted(ids)
        edges = [0] + [e.end for e in got]
        assert [e.start for e in got] == edges[:-1] and edges[-1] == len(data)  # records and gaps cover every byte once
        if r.random() < 0.5:  # bytes lost from the middle of a record: the rest of the archive moves
            i = r.randrange(1, 11)
            a = r.randrange(starts[i] + 1, starts[i + 1] - 1)
            lost = b"".join(parts)[: a] + b"".join(parts)[a + r.randint(1, starts[i + 1] - a) :]
            ids = [warc.page_of(e.fields["warc-record-id"]) for e in warc.salvaged(lost) if not e.problem]
            assert {k for k in range(12) if k != i} <= set(ids)
    assert list(warc.salvaged(b"")) == []
    assert [(e.start, e.end, bool(e.problem)) for e in warc.salvaged(b"no archive")] == [(0, 10, True)]


def test_quarantine_of_a_damaged_file(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"text {i} " * 30) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"{tmp_path}/a")
    (file,) = (tmp_path / "a").glob("part-*")
    data = file.read_bytes()
    middle = list(warc.salvaged(data))[20]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc.gz").write_bytes(data[: middle.start + 30] + b"junk" + data[middle.start + 34 :])
    found = warc.read_archives(spark, f"{tmp_path}/b")
    assert sorted(r.page_id for r in warc.records(found).collect()) == [i for i in range(40) if i != warc.page_of(middle.fields["warc-record-id"])]
    (gap,) = warc.quarantine(found).collect()
    assert (gap.start, gap.end) == (middle.start, middle.end) and gap.archive.endswith("x.warc.gz")


def test_members_are_read_by_other_readers():
    whole = b"".join(warc.member(warc.record(i, "u", b"x" * i)) for i in range(5))
    plain, rest = b"", whole
    while rest:
        z = zlib.decompressobj(31)
        plain, rest = plain + z.decompress(rest), z.unused_data
    assert plain == b"".join(warc.record(i, "u", b"x" * i) for i in range(5))


VECTORS = "vec_id long, embedding array<double>, label int"


def vectors(n: int = 700, dims: int = 8, seed: int = 5) -> list[tuple]:
    r = np.random.default_rng(seed)
    centres = r.normal(size=(30, dims))
    x = np.round(centres[r.integers(0, 30, n)] + r.normal(size=(n, dims)) * 0.2, 2)
    rows = [(int(i), x[i].tolist(), int(r.integers(0, 4)) if i % 9 else None) for i in range(n)]
    rows[5:9] = [(i, rows[4][1], 1) for i in range(5, 9)]  # equal entries
    return rows


def plain_codes(rows: list[tuple], parts: int, entries: int, rounds: int) -> dict:
    kept = sorted((i, np.floor(np.array(v) * 1024).astype(np.int64)) for i, v, _ in rows)
    x = np.array([v for _, v in kept]).reshape(len(kept), parts, -1).astype(object)
    books = [x[:entries, p].copy() for p in range(parts)]

    def assigned(p: int) -> tuple[np.ndarray, np.ndarray]:
        d = ((x[:, p][:, None] - books[p][None]) ** 2).sum(axis=2)
        own = np.array([min(range(d.shape[1]), key=lambda j: (d[i, j], j)) for i in range(len(d))])
        return own, d[np.arange(len(d)), own]

    for _ in range(rounds):
        for p in range(parts):
            own, _d = assigned(p)
            for e in set(own.tolist()):
                met = x[own == e, p]
                books[p][e] = [int(s) // len(met) for s in met.sum(axis=0)]
    final = [assigned(p) for p in range(parts)]
    out = {i: ("".join(f"{int(final[p][0][k]):02x}" for p in range(parts)), int(sum(final[p][1][k] for p in range(parts)))) for k, (i, _) in enumerate(kept)}
    return out, hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


@pytest.mark.parametrize(("entries", "rounds"), [(16, 4), (40, 2), (256, 1)])
def test_vector_codes(spark, entries, rounds):
    rows = vectors(300 if entries > 100 else 700)
    want, digest = plain_codes(rows, 4, entries, rounds)
    wrong = [(1000, None, 1), (1001, [None, *[0.0] * 7], 1), (1002, [float("nan")] * 8, 1), (1003, [*[0.0] * 7, float("-inf")], 1), (1004, [], 1), (1005, [1.0] * 4, 1), (-1, [1.0] * 7, 1), (1006, [1e300] * 8, 1)]
    df = spark.createDataFrame(rows + wrong, VECTORS).select("*", *[F.lit("own").alias(c) for c in ("code", "error", "vector", "key", "dims")]).repartition(3)
    codes, books = vector_codes.coded(df, entries=entries, rounds=rounds)
    got = vector_codes.with_label_errors(codes).collect()
    assert {r.vec_id: (r.code, r.error) for r in got} == want
    assert vector_codes.codebooks_digest(books) == digest
    labels = {i: k for i, _, k in rows}
    assert all(r.label_error == sum(e for i, (_, e) in want.items() if labels[i] == labels[r.vec_id]) for r in got)


def test_vector_codes_of_odd_tables(spark):
    rows = [(3, [0.5, -0.5], None), (3, [0.25, 0.25], None), (None, [0.5, -0.5], 2), (7, [0.5, -0.5], 2)]
    codes, books = vector_codes.coded(spark.createDataFrame(rows, VECTORS), parts=2)
    assert sorted((r.vec_id, r.code, r.error) for r in codes.where("vec_id is not null").collect()) == [(3, "0000", 0), (3, "0101", 0), (7, "0101", 0)]
    assert codes.count() == 4 and codes.agg(F.sum("error")).first()[0] == 0
    none, books = vector_codes.coded(spark.createDataFrame(rows, VECTORS).limit(0))
    assert vector_codes.with_label_errors(none).count() == 0 and books == []


@pytest.mark.parametrize("unit", [1, 7])
@pytest.mark.parametrize("scale", [3, 1000, 1 << 25])
def test_bounds_pass_over_no_nearest_entry(unit, scale):
    r = np.random.default_rng(scale + unit)
    x = np.floor(r.normal(size=(500, 4)) * scale).astype(np.int64)
    entries, held = x[:50].copy(), None
    entries[7] = entries[3]
    books, saved = vector_codes.Codebook(entries, np.zeros(50, np.int64), unit), 0
    held = vector_codes.first_bounds(x, books)
    for _ in range(6):
        new = books.entries.copy()
        for e in set(held.own.tolist()):
            new[e] = x[held.own == e].sum(axis=0) // (held.own == e).sum()
        books = vector_codes.Codebook(new, vector_codes.ceil_root(((new - books.entries) ** 2).sum(axis=1)), unit)
        held, taken = vector_codes.next_bounds(x, books, held)
        saved += x.shape[0] * 50 - taken
        squares = ((x[:, None].astype(object) - new[None].astype(object)) ** 2).sum(axis=2)
        assert held.own.tolist() == [min(range(50), key=lambda j: (row[j], j)) for row in squares]
        own = squares[np.arange(500), held.own]
        assert all(u * u >= d for u, d in zip(held.upper.tolist(), own, strict=True))
        assert (held.lower.astype(object) * unit) .__pow__(2).__le__(squares).all()
    assert saved > 0


def test_roots_of_large_squares():
    r = random.Random(0)
    roots = [0, 1, 2, 3, *[r.getrandbits(31) for _ in range(2000)], (1 << 31) - 1]
    for off in (-1, 0, 1):
        squares = np.array([max(0, x * x + off) for x in roots], np.int64)
        floor, ceil = vector_codes.floor_root(squares).tolist(), vector_codes.ceil_root(squares).tolist()
        assert all(f * f <= s < (f + 1) ** 2 and (c - 1) ** 2 < s <= c * c or s == 0 == c for f, c, s in zip(floor, ceil, squares.tolist(), strict=True))


def test_binary_rows_keep_offsets():
    own = np.arange(24, dtype="<i4").reshape(6, 4)
    column = vector_codes._binary(own)
    assert (vector_codes._rows(column.slice(2, 3), "<i4", 4) == own[2:5]).all() and column.type == pa.binary()
