"""Packing token sequences by harmonic classes."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, table, words, written

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END = 1
#: A piece may be short of its class's length by a SLACK-th of it; what is shorter is cut.
SLACK = 128
#: Words whose ids a Python worker remembers, and parts of words beside them.
REMEMBERED = 250_000
#: Marks at a word's end that the tokenizer splits off as one run, and letters' runs that are encoded at a time.
MARKS, RUN = ".,;:!?", 2000
#: Sequence ids of the tail start here; those of task p at p * 2^32.
TAIL = 1 << 60


@dataclass
class Memory:
    """Ids of strings that a Python worker has met: string number k has ids[starts[k]:starts[k + 1]]."""

    number: dict[str, int] = field(default_factory=dict)
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def found(self, strings: list[str], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, sizes) of different strings; `encode` gives ids and sizes of those not met before."""
        number = np.fromiter(map(self.number.get, strings, repeat(-1)), np.int64, len(strings))
        ids, starts, unmet = self.ids, self.starts, np.flatnonzero(number < 0)
        if len(unmet):
            new = [strings[i] for i in unmet.tolist()]
            got, sizes = encode(new)
            first = len(starts) - 1
            number[unmet] = first + np.arange(len(new))
            ids = np.concatenate([ids, got])
            starts = np.concatenate([starts, starts[-1] + np.cumsum(sizes)])
            if len(self.number) < REMEMBERED:
                self.number.update(zip(new, range(first, first + len(new)), strict=True))
                self.ids, self.starts = ids, starts
        return ids, starts[number], starts[number + 1] - starts[number]


@dataclass
class Known:
    """A tokenizer with its vocabulary's marks of a word's end, and what a worker has met of it."""

    tokenizer: object
    ends: np.ndarray
    words: Memory = field(default_factory=Memory)
    parts: Memory = field(default_factory=Memory)


_known: dict[str, Known] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _parts(word: str) -> tuple[str, str]:
    """A word of Latin-1 letters in lower case, and the marks after it; the whole of any other word."""
    core = word.rstrip(MARKS)
    return (core.lower(), word[len(core) :]) if core.isalpha() and (core.isascii() or max(core) <= "\xff") else (word, "")


def _gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _encoded(known: Known, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes) of strings. Letters alone are one word to the tokenizer, whose last id alone marks the end of a word, so
    many are encoded at a time."""
    letters = [s.isalpha() and (s.isascii() or max(s) <= "\xff") for s in strings]
    runs, rest = [s for s, one in zip(strings, letters, strict=True) if one], [s for s, one in zip(strings, letters, strict=True) if not one]
    joined = [" ".join(runs[i : i + RUN]) for i in range(0, len(runs), RUN)]
    got = [np.array(e.ids, np.uint32) for e in known.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
    flat = np.concatenate([np.zeros(0, np.uint32), *got])
    sizes = np.diff(np.flatnonzero(known.ends[flat]), prepend=-1)
    if len(sizes) != len(runs) or sizes.sum() != len(flat):  # a vocabulary without such marks
        flat, sizes = _singly(known, runs)
    other, lengths = _singly(known, rest)
    mask = np.array(letters, bool)
    starts, size = np.empty(len(strings), np.int64), np.empty(len(strings), np.int64)
    size[mask], size[~mask] = sizes, lengths
    starts[mask], starts[~mask] = np.cumsum(sizes) - sizes, len(flat) + np.cumsum(lengths) - lengths
    return _gathered(np.concatenate([flat, other]), starts, size), size


def _singly(known: Known, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    got = [e.ids for e in known.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
    sizes = np.fromiter(map(len, got), np.int64, len(got))
    return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes


def _ids(vocab: list[str], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, sizes) of single words. The tokenizer drops white space and never joins across it, so a text's ids
    are its words'; it lowers letters and splits marks from them, so a word's ids are its parts'."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path not in _known:
        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        _known[path] = Known(tokenizer, ends)
    known = _known[path]

    def by_parts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [p for w in words for p in (_parts(w) if plain else (w, ""))]
        different = list(dict.fromkeys(parts))
        place = dict(zip(different, range(len(different)), strict=True))
        ids, starts, sizes = known.parts.found(different, lambda new: _encoded(known, new))
        at = np.fromiter(map(place.__getitem__, parts), np.int64, len(parts))
        return _gathered(ids, starts[at], sizes[at]), sizes[at].reshape(-1, 2).sum(axis=1)

    plain = bool(known.ends.any())
    return known.words.found(vocab, by_parts)


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, starts): ids of all texts, each followed by END; text r owns ids[starts[r]:starts[r + 1]]."""
    w = words(texts)
    flat, at, size = _ids(w.vocab.to_pylist(), path)
    # every text is its words and one more, the end
    n = w.counts
    length = np.ones(len(w.codes) + len(n), np.int64)
    source = np.full(len(length), len(flat), np.int64)
    place = np.arange(len(w.codes)) + w.rows
    length[place], source[place] = size[w.codes], at[w.codes]
    flat = np.append(flat, np.uint32(END))
    ends = np.cumsum(length)
    ids = flat[np.repeat(source - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
    last = w.starts[1:] + np.arange(len(n))
    return ids, np.concatenate([[0], ends[last]]).astype(np.int64)


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(piece length, class k) of a document: whole sequences, then pieces that fill a k-th of one nearly or wholly."""
    out = [(capacity, 1)] * (length // capacity)
    left = length % capacity
    while left:
        k = capacity // left  # the most pieces of this length that a sequence takes
        if (capacity // k - left) * SLACK > capacity // k:
            k += 1
        piece = min(left, capacity // k)
        out.append((piece, k))
        left -= piece
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, at long, ids binary"


def _packer(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sequences, open_ = TaskContext.get().partitionId(), 0, {}
        layout = {}

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "at", "ids"]
        schema = pa.schema([*[(n, pa.int64()) for n in names[:-1]], ("ids", pa.binary())])
        for block in blocks(batches, "text"):
            ids, starts = token_ids(block.column("text"), path)
            raw, done = ids.astype("<u4").tobytes(), []
            for doc, a, b in zip(block.column("doc_id").to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if (total := b - a) not in layout:
                    layout[total] = cuts(total, capacity)
                start = 0
                for length, k in layout[total]:
                    own = raw[4 * (a + start) : 4 * (a + start + length)]
                    piece = (doc, start, length, zlib.crc32(own), total, own if k > 1 else b"")
                    start += length
                    held = open_.setdefault(k, [])
                    held.append(piece)
                    if len(held) == k:  # the class's fixed count: a sequence is full
                        offset = 0
                        for p in held:
                            done.append((*p[:5], (part << 32) + sequences, offset, part, None, None))
                            offset += p[2]
                        sequences += 1
                        held.clear()
            if done:
                yield batch(done)
        rest, at = [], 0
        for k in sorted(open_):
            for p in open_[k]:
                rest.append((*p[:5], None, None, part, at, p[5]))
                at += p[2]
        if rest:
            yield batch(rest)

    return run


def _tail_pieces(capacity: int):
    """Cuts pieces that lie end to end from `from_` on where a sequence ends, and the last sequence into powers of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                at, to, whole = r["from_"], r["from_"] + r["length"], r["total"] - r["total"] % capacity
                while at < to:
                    if at < whole:
                        seq, base, size = at // capacity, at - at % capacity, capacity
                    else:  # the rest's binary digits, the largest first
                        base, rest, seq = whole, r["total"] - whole, whole // capacity
                        while True:
                            size = 1 << (rest.bit_length() - 1)
                            if at < base + size:
                                break
                            base, rest, seq = base + size, rest - size, seq + 1
                    end = min(to, base + size)
                    own = r["ids"][4 * (at - r["from_"]) : 4 * (end - r["from_"])]
                    out.append({"doc_id": r["doc_id"], "start": r["start"] + at - r["from_"], "length": end - at, "ids_crc32": zlib.crc32(own), "doc_tokens": r["doc_tokens"], "sequence_id": TAIL + seq, "offset": at - base})
                    at = end
            fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(n, pa.int64()) for n in fields]))

    return run


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids end with END. Lengths fall into reciprocal-capacity classes: class k takes pieces of a k-th of the
    capacity, nearly or wholly, and k of them fill a sequence. A document gives whole sequences, then a piece of the
    largest class that it fills, and so on with what is left. Each task fills its classes' sequences by itself. What
    remains open in them (under one sequence for each class and task) is laid end to end over all tasks, by sums over
    one row per task, and cut where a sequence ends; the last, partial sequence is cut into powers of two, which need no
    padding. So padding is only what a class leaves: under a 128th of a sequence, and k - 1 tokens.

    Null and empty texts have the end alone. Repeated rows are packed each; a null doc_id stays null; other columns are
    not read. An empty table gives an empty result. No document is cut short or left out."""
    path = path or tokenizer_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(rows.mapInArrow(_packer(path, capacity), SCHEMA), "pieces")
    full, tail = pieces.where("sequence_id is not null"), pieces.where("sequence_id is null")
    tasks = tail.groupBy("part").agg(F.sum("length").alias("tokens"))  # a row for each task
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = tasks.select("part", F.coalesce(F.sum("tokens").over(over), F.lit(0)).alias("base"), F.sum("tokens").over(Window.partitionBy()).alias("total"))
    laid = tail.join(bases, "part").select("doc_id", "start", "length", "doc_tokens", "ids", (F.col("base") + F.col("at")).alias("from_"), "total")
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ends = laid.mapInArrow(_tail_pieces(capacity), ", ".join(f"{c} long" for c in fields))
    return full.select(*fields).unionByName(ends)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
