"""WARC archives of pages, with revisits for equal payloads, and a reader that salvages what damaged archives still hold."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, shared_dir, table, written

#: Records of one archive. Archives also end with their task, so that each can be read whole by one.
ARCHIVE_RECORDS = 4096
#: Payloads of so many bytes may be replaced by a revisit of an equal one.
LEAST_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the WARC 1.1 standard.
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."

#: A gzip member ends with the high byte of its content's size, which is 0 for less than 16 MB.
MEMBER_BYTES = (1 << 24) - 1
#: Bytes given to the decompressor at once; of a record's header; of a record.
CHUNK, HEAD_BYTES, RECORD_BYTES = 1 << 14, 1 << 16, (1 << 31) - 1


def digest_of(content: bytes | memoryview) -> str:
    return base64.b32encode(hashlib.sha1(content).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A version 8 UUID that holds the page's id. Rows that share a page_id share it."""
    own = (page_id or 0) & (1 << 64) - 1
    return f"<urn:uuid:{uuid.UUID(int=own >> 16 << 80 | 8 << 76 | (page_id is None) << 64 | 2 << 62 | own & 0xFFFF)}>"


def page_of(id_: str | None) -> int | None:
    """The page's id in a record's; null in those of other writers."""
    try:
        n = uuid.UUID((id_ or "").strip("<>").removeprefix("urn:uuid:")).int
    except ValueError:
        return None
    own = n >> 80 << 16 | n & 0xFFFF
    if record_id(own) != (id_ or "").lower():
        return None
    return own - (1 << 64) if own >> 63 else own


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = DATE) -> bytes:
    """One record: a response with its payload, or a revisit of the page `refers_to` with the payload's HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f<>]", lambda c: f"%{ord(c[0]):02X}", url or "about:blank")
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date), ("WARC-Target-URI", target)]
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))] if revisit else []
    fields += [("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("WARC-Block-Digest", f"sha1:{digest_of(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(content: bytes, level: int = 6) -> bytes:
    """content as a gzip member; over 16 MB, as one after the other."""
    out = []
    for at in range(0, len(content), MEMBER_BYTES):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += [z.compress(content[at : at + MEMBER_BYTES]), z.flush()]
    return b"".join(out)


class Entry(NamedTuple):
    """A record, or a gap of bytes that hold none: then `problem` says which check failed first."""

    start: int
    end: int
    problem: str | None
    fields: dict
    block: bytes


class Damaged(Exception):
    """A check of a record has failed."""


def _inflated(data: bytes, at: int, first: bool = True) -> tuple[bytes, int]:
    """The content of the gzip member at a place, whose length and checksum are right, and the member's end."""
    z, out, size, view = zlib.decompressobj(31), [], 0, memoryview(data)
    while not z.eof:
        if at >= len(data):
            raise Damaged("member is cut off")
        try:
            got = z.decompress(view[at : at + CHUNK])
        except zlib.error as e:
            raise Damaged("member does not decode") from e
        at = min(at + CHUNK, len(data))
        if first and not size and got and not got.startswith(VERSION[: len(got)]):
            raise Damaged("member without a version line")
        size += len(got)
        if size > RECORD_BYTES:
            raise Damaged("record is too long")
        out.append(got)
    return b"".join(out), at - len(z.unused_data)


def _parsed(data: bytes, at: int) -> tuple[dict, int, int]:
    """The fields of the record at a place of plain bytes, and where its block begins and ends."""
    head = data.find(b"\r\n\r\n", at, at + HEAD_BYTES)
    lines = data[at : max(head, at)].split(b"\r\n")
    if lines[0] not in VERSIONS:
        raise Damaged("no version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise Damaged("header line without a name")
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not all(fields.get(c) for c in MANDATORY) or not re.fullmatch("[0-9]{1,10}", length):
        raise Damaged("header without a mandatory field")
    return fields, head + 4, head + 4 + int(length)


def _record_at(data: bytes, at: int) -> Entry:
    """The record at a place, plain or in gzip members, if all its checks hold."""
    if data.startswith(MAGIC, at):
        raw, end = _inflated(data, at)
        fields, begin, to = _parsed(raw, 0)
        while to + 4 > len(raw) and data.startswith(MAGIC, end):  # a record of several members
            more, end = _inflated(data, end, first=False)
            if more.startswith(VERSION):
                raise Damaged("record is cut off")
            raw += more
    else:
        raw = data
        fields, begin, to = _parsed(raw, at)
        end = to + 4
    if raw[to : to + 4] != b"\r\n\r\n" or (raw is not data and to + 4 != len(raw)):
        raise Damaged("record does not end where its length says")
    block = raw[begin:to]
    if (said := fields.get("warc-block-digest", "").removeprefix("sha1:")) and said.upper() != digest_of(block):
        raise Damaged("block does not have its digest")
    return Entry(at, end, None, fields, block)


def salvaged(data: bytes) -> Iterator[Entry]:
    """All records of an archive that pass their checks, and the gaps between them.

    Where a check fails, the next gzip member or version line that begins a whole, right record is searched for, also
    inside what the failed record claimed as its own; all bytes from the failure to there are one gap."""
    at, gap, problem, found = 0, 0, None, {MAGIC: -1, VERSION: -1}
    while at < len(data):
        try:
            entry = _record_at(data, at)
        except Damaged as e:
            problem = problem or str(e)
            at += 1
            for mark, place in found.items():
                if place < at:
                    place = data.find(mark, at)
                    found[mark] = place if place >= 0 else len(data)
            at = min(found.values())
            continue
        if problem:
            yield Entry(gap, at, problem, {}, b"")
        yield entry
        at = gap = entry.end
        problem = None
    if problem:
        yield Entry(gap, len(data), problem, {}, b"")


def _writer(gzip: bool, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "html", BLOCK_BYTES):
            out = []
            for page, url, html, first in zip(*(block.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                whole = record(page, url, html.encode(), first if first is not None and first != page else None)
                out.append((member(whole, level) if gzip else whole)[:-1])  # Spark's writer ends each row with the last byte
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return run


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, gzip: bool = True, level: int = 6, records: int = ARCHIVE_RECORDS) -> None:
    """Writes a record per row of pages (page_id, url, html) into archives at a path, each record a gzip member of its own.

    Of equal payloads of at least `least_bytes` bytes that of the smallest page_id is a response and the others revisit
    it. Only digests are shuffled to find them; ids of repeated payloads come to the pages by a broadcast if Spark measures
    their written table as small, else by sort and merge, where a payload that very many pages share is split. The files
    are written by Spark's text writer, so that any file system it reaches will do: a record's last byte is its line end.

    A null html is an empty payload. Rows that share the smallest page_id of a payload are responses all, and rows without a
    page_id are never referred to, but revisit the smallest id that has one. A null url becomes about:blank. Repeated rows
    are written each, other columns are not read, and an empty table gives archives without records. Records over 16 MB are
    several members."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    copies = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    joined = rows.join(written(copies.select("digest", "first"), "copies"), "digest", "left").select("page_id", "url", "html", "first")
    lines = joined.mapInArrow(_writer(gzip, level), "record binary").select(F.col("record").cast("string"))
    lines.write.option("lineSep", "\x00" if gzip else "\n").option("maxRecordsPerFile", records).text(path)


SCHEMA = "archive string, start long, end long, problem string, record_type string, record_id string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"
ARROW = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in SCHEMA.split(", ")])


def _row(archive: str, e: Entry, payloads: bool) -> tuple:
    """A row of the reader. A revisit's payload has the size that the HTTP header it kept tells."""
    if e.problem:
        return (archive, e.start, e.end, e.problem, *[None] * 8)
    get = e.fields.get
    kind, payload, size = get("warc-type"), e.block, None
    if get("content-type", "").startswith("application/http"):
        head, _, payload = e.block.partition(b"\r\n\r\n")
        told = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})\r?$", head)
        size = int(told[1]) if told else None
    whole = kind != "revisit"
    said = get("warc-payload-digest", "").removeprefix("sha1:").upper() or None
    own = digest_of(payload) if whole else said
    problem = "payload does not have its digest" if whole and said and said != own else None
    return (archive, e.start, e.end, problem, kind, get("warc-record-id"), get("warc-target-uri"), page_of(get("warc-record-id")), page_of(get("warc-refers-to")), len(payload) if whole else size, own, payload if payloads and whole else None)


def _reader(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                archive, held, size = batch.column("path")[i].as_py(), [], 0
                for entry in salvaged(batch.column("content")[i].as_py()):
                    held.append(_row(archive, entry, payloads))
                    size += len(entry.block) if payloads else 0
                    if len(held) == 1024 or size > BLOCK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), ARROW, strict=True)], schema=ARROW)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), ARROW, strict=True)], schema=ARROW)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All that archives at a path hold: a row per record, and one per gap, whose `problem` is not null.

    Each task reads whole archives and goes on behind damaged places (see `salvaged`), so a broken archive costs its broken
    records alone; `start` and `end` are bytes of the archive. A response whose payload lacks its digest is a problem too. A
    revisit has the digest and the size of the payload that it refers to, and no payload. Archives may be plain, gzip by
    record, or both; plain headers have no checksum, so that of a plain record a changed value may go unseen. Empty archives give no rows; an archive needs a few times its size of memory."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_reader(payloads), SCHEMA)


def records(entries: DataFrame) -> DataFrame:
    return entries.where("problem is null")


def quarantine(entries: DataFrame) -> DataFrame:
    """The log of what could not be read: archive, start, end, problem."""
    return entries.where("problem is not null").select("archive", "start", "end", "problem")


def query(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/windrow-warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return records(read_archives(spark, path, payloads=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h, min(page_id) over (partition by coalesce(html, '')) as first
  from pages),
d as (
  select page_id, html, first, list_transform(range(0, 8), lambda i: ('0x' || substr(h, (5 * i + 1)::bigint, 5))::bigint) as groups
  from p)
select page_id, strlen(html)::bigint as payload_bytes,
       array_to_string(list_transform(groups, lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((g >> s::bigint) & 31) + 1, 1)), '')), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from d
"""
