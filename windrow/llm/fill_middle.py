"""Fill-in-the-middle: whole texts cut at two tokens and put in prefix-suffix-middle orders, cuts found on runs of character classes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, table

#: What stands before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
SEED = 42
#: Of 100 texts so many are rearranged, and of 100 rearranged ones so many have the suffix first.
RATE, SUFFIX_FIRST = 50, 80

#: Classes of characters: white space, then others by the bytes that each takes; a later byte of a character is INNER.
SPACE, INNER, END = 0, 9, 10
CLASS = np.array([INNER if 0x80 <= b < 0xC0 else SPACE if b == 32 or 9 <= b <= 13 else 1 + (b >= 0xC0) + (b >= 0xE0) + (b >= 0xF0) for b in range(256)], np.uint8)


@dataclass
class Runs:
    """Maximal runs of one class, over the texts of a block: run i is the bytes from starts[i] to starts[i + 1], of
    characters of widths[i] bytes; chars[i] characters and units[i] units end before it."""

    starts: np.ndarray
    widths: np.ndarray
    chars: np.ndarray
    units: np.ndarray

    def offsets(self, units: np.ndarray) -> np.ndarray:
        """The byte at which so many units of the block have ended. A unit ends with its run."""
        return self.starts[np.searchsorted(self.units, units)]

    def chars_before(self, offsets: np.ndarray) -> np.ndarray:
        """Characters before a byte: those before its run and, by their width, those of the run itself."""
        run = np.searchsorted(self.starts, offsets, side="right") - 1
        return self.chars[run] + (offsets - self.starts[run]) // self.widths[run]


def class_runs(data: np.ndarray, bounds: np.ndarray, after: int = END) -> Runs:
    """Runs of UTF-8 bytes, text by text: bounds are the texts' ends, with 0 before them. `after` is the class of what
    follows the last text, where that is a piece of one.

    A unit is white space with the other characters that follow it, or white space at a text's end."""
    kinds = CLASS[data]
    for _ in range(3):
        inner = np.flatnonzero(kinds == INNER)
        if not len(inner):
            break
        kinds[inner] = kinds[inner - 1]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = kinds[1:] != kinds[:-1]
    ends_text = np.zeros(len(data) + 1, bool)
    ends_text[bounds] = True
    edges = np.flatnonzero(edge | ends_text)
    kind = kinds[edges[:-1]]
    last = ends_text[edges[1:]]
    if len(last):
        last[-1] &= after == END
    unit = np.where(kind == SPACE, last, last | (np.append(kind[1:], after)[: len(kind)] == SPACE))
    widths = np.maximum(kind, 1).astype(np.int64)
    counted = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return Runs(edges, np.append(widths, 1), counted(np.diff(edges) // widths), counted(unit))


@dataclass
class Cuts:
    """Of each text: its units, the bytes where prefix and middle end, and the characters before these."""

    n: np.ndarray
    offsets: np.ndarray
    chars: np.ndarray


def _chosen(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.sort(h % (n + 1), axis=0)


def cuts(data: np.ndarray, bounds: np.ndarray, h: np.ndarray) -> Cuts:
    """Cuts of a block of texts after h[0] % (n + 1) and h[1] % (n + 1) of their n units; offsets count from the text's start."""
    runs = class_runs(data, bounds)
    base = runs.units[np.searchsorted(runs.starts, bounds)]
    n = np.diff(base)
    units = _chosen(h, n)
    # where no unit has ended the cut is the text's start, which may be the end of other texts' units
    offsets = np.where(units > 0, runs.offsets(base[:-1] + units), bounds[:-1])
    before = runs.chars_before(bounds[:-1])
    return Cuts(n, offsets - bounds[:-1], runs.chars_before(offsets) - before)


def long_cuts(data: np.ndarray, h: np.ndarray, piece: int = BLOCK_BYTES) -> Cuts:
    """The same of one long text, of which the runs of one piece at a time are held.

    A first reading counts the units and characters of the pieces; only pieces in which a cut falls are read again."""
    edges = [0]
    while edges[-1] < len(data):
        to = min(edges[-1] + piece, len(data))
        while to < len(data) and CLASS[data[to]] == INNER:
            to += 1
        edges.append(to)

    def read(i: int) -> Runs:
        own = data[edges[i] : edges[i + 1]]
        return class_runs(own, np.array([0, len(own)]), int(CLASS[data[edges[i + 1]]]) if edges[i + 1] < len(data) else END)

    sums = np.array([[0, 0], *[[r.units[-1], r.chars[-1]] for r in map(read, range(len(edges) - 1))]], np.int64).cumsum(axis=0)
    n = sums[-1:, 0]
    units, offsets, chars = _chosen(h, n), np.zeros((2, 1), np.int64), np.zeros((2, 1), np.int64)
    for cut, unit in enumerate(units[:, 0]):
        if unit:
            i = int(np.searchsorted(sums[:, 0], unit)) - 1
            runs = read(i)
            at = runs.offsets(np.array([unit - sums[i, 0]]))
            offsets[cut], chars[cut] = edges[i] + at, sums[i, 1] + runs.chars_before(at)
    return Cuts(n, offsets, chars)


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _rearranger(marks: tuple[str, str, str], rate: int, suffix_first: int, piece: int):
    p, s, m = (x.encode() for x in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", piece):
            texts = pc.fill_null(block.column("text"), "").cast(pa.large_binary())
            h = np.array([block.column(f"h{i}").to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4)])
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            raw = texts.buffers()[2]
            start = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset]
            data = np.frombuffer(raw, np.uint8)[start : start + bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
            found = long_cuts(data, h[:2], piece) if len(sizes) == 1 and sizes[0] > piece else cuts(data, bounds, h[:2])
            marked = np.logical_or.reduce([pc.match_substring(texts, x).to_numpy(zero_copy_only=False) for x in (p, s, m)])
            plain = (sizes == 0) | marked | (h[2] % 100 >= rate)
            forms = np.where(plain, "plain", np.where(h[3] % 100 < suffix_first, "spm", "psm"))
            out = []
            for form, text, a, b in zip(forms.tolist(), texts.to_pylist(), *found.offsets.tolist(), strict=True):
                if form != "plain":
                    text = b"".join((p, text[:a], s, text[b:], m, text[a:b]) if form == "psm" else (s, text[b:], p, text[:a], m, text[a:b]))
                out.append(text)
            chars = found.chars
            columns = [block.column("doc_id"), found.n, forms.tolist(), pa.array(chars[0], mask=plain), pa.array(chars[1] - chars[0], mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], schema=ARROW)

    return run


def restored(form: str | Column, output: str | Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of, read from the output and its form alone."""
    form, output = (F.col(x) if isinstance(x, str) else x for x in (form, output))
    p, s, m = map(F.lit, marks)

    def part(mark: Column, *later: Column) -> Column:
        out = F.split_part(output, mark, F.lit(2))
        for x in later:
            out = F.split_part(out, x, F.lit(1))
        return out

    prefix, suffix, middle = part(p, s, m), part(s, p, m), part(m)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))


def fill_in_middle(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS, seed: int = SEED, piece: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each whole text with its middle moved to the end, or as it is.

    A text has n units, each white space and the characters up to the next white space. Its id's SHA-256 with the seed
    gives two cuts between units, whether it is rearranged (`rate` of 100) and whether the suffix comes first
    (`suffix_first` of 100 of those): form psm, spm or plain. Texts are stored as maximal runs of one character class
    with cumulative counts of units and characters: the run of a cut is found by binary search, and characters before it
    by the width of its characters. Each row is worked on by itself where it is read; nothing is shuffled.

    Null and empty texts, and texts that hold a mark, are plain; n is 0 for the first two. A very long text is read in pieces
    of `piece` bytes. Rows that share a doc_id are cut alike, if their texts are; a null doc_id counts as an empty one and
    stays null. Other columns are not read. An empty table gives an empty result."""
    first = {x[:1] for x in marks}
    if len(set(marks)) < 3 or "" in marks or any(c in x[1:] for c in first for x in marks) or any(a != b and a.startswith(b) for a in marks for b in marks):
        raise ValueError("marks differ, none begins another, and their first characters stand nowhere else in them")
    own = F.col("doc_id").cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(own.cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(own.alias("doc_id"), F.col("text").cast("string").alias("text"), *groups)
    return rows.mapInArrow(_rearranger(marks, rate, suffix_first, piece), SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("form", "output"), 256).alias("restored_sha256"))


ORACLE = r"""
with t as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || doc_id::varchar) as h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u
  from documents),
c as (
  select doc_id, text, u, len(u)::bigint as n,
         ('0x' || substr(h, 1, 8))::bigint % (len(u) + 1) as a, ('0x' || substr(h, 9, 8))::bigint % (len(u) + 1) as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || substr(h, 17, 8))::bigint % 100 >= 50 then 'plain'
              when ('0x' || substr(h, 25, 8))::bigint % 100 < 80 then 'spm' else 'psm' end as form
  from t),
p as (
  select doc_id, text, n, form,
         coalesce(array_to_string(u[1 : least(a, b)], ''), '') as prefix,
         coalesce(array_to_string(u[least(a, b) + 1 : greatest(a, b)], ''), '') as middle,
         coalesce(array_to_string(u[greatest(a, b) + 1 :], ''), '') as suffix
  from c),
o as (
  select *, case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end as output
  from p)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars, case when form <> 'plain' then length(middle) end::bigint as middle_chars,
       sha256(output) as output_sha256, sha256(text) as restored_sha256
from o
"""
