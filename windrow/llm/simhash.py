"""SimHash near-duplicates: fingerprints of word shingles, linked through an index of positional bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, fresh, written
from .components import connected_components

#: Fingerprints have this many bytes of 8 bits.
BYTES = 8
#: Bytes of a key of the index, and the length from which a posting list is pruned by one more byte.
KEY_BYTES, LONG = 3, 512


def shingles(text: str | None, size: int, seed: int) -> np.ndarray:
    """XXH64 of every run of `size` words, in order; of all words where there are fewer."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, ">u8")
    joined, size = b" ".join(w), min(size, len(w))
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[size - 1 :].tolist(), strict=False)], ">u8")


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashed shingles; 0 without any."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def _fingerprint(text: str | None, size: int, seed: int) -> int:
    return majority(shingles(text, size, seed))


def fingerprints(docs: DataFrame, shingle_words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, th, fp): the 64-bit SimHash of every document, as a signed long; th hashes the text.

    Words are runs of other than white space in the text with A-Z lower-cased; a text with fewer words than a
    shingle counts as one shingle, one without words (or null) has fingerprint 0. A bit is 1 if more than half of
    the shingles' XXH64 values have it, repeats counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            fp = np.array([_fingerprint(t, shingle_words, seed) for t in block.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("th"), pa.array(fp.view(np.int64))], ["doc_id", "th", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash().alias("th"))
    return rows.mapInArrow(run, "doc_id long, th long, fp long")


def _byte(i: int):
    return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))


def position_sets(max_bits: int, key_bytes: int = 3) -> list[tuple[int, ...]]:
    """Sets of byte positions of which every pair of fingerprints within max_bits agrees on one wholly.

    Such a pair has at least BYTES - max_bits equal bytes (the guaranteed matches), so the sets must hit every choice
    of that many positions; chosen greedily, in a fixed order."""
    matches = BYTES - max_bits
    if matches < 1:
        raise ValueError("a pair within max_bits may share no byte")
    size = min(key_bytes, matches)
    open_, chosen = set(combinations(range(BYTES), matches)), []
    pool = list(combinations(range(BYTES), size))
    while open_:
        best = max(pool, key=lambda s: (sum(set(s) <= set(o) for o in open_), [-x for x in s]))
        chosen.append(best)
        open_ = {o for o in open_ if not set(best) <= set(o)}
    return chosen


def index_keys(sets: list[tuple[int, ...]]) -> list:
    """A column for each position set: its number and its bytes of fp."""
    keys = []
    for k, positions in enumerate(sets):
        key = F.lit(k).cast("long")
        for i in positions:
            key = key * 256 + _byte(i)
        keys.append(key)
    return keys


def _postings(fps: DataFrame, sets: list[tuple[int, ...]], *more: str) -> DataFrame:
    """The inverted index: a row for each fingerprint and position set, key = set number and its bytes."""
    return fps.select(F.explode(F.array(*index_keys(sets))).alias("key"), "fp", *more)


def _close(pairs: DataFrame, a: str, b: str, max_bits: int) -> DataFrame:
    """Verification: few enough differing bits."""
    return pairs.where(F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits)


def _pruned(rows: DataFrame, sets: list[tuple[int, ...]], long_list: int) -> DataFrame:
    """rows (key, size, fp, ...) with a key `part`: a long list's members are dealt by one byte more, at each other position.

    Sets are smaller than the guaranteed matches there, so a pair that is to be found agrees on one more byte."""
    parts = []
    for k, positions in enumerate(sets):
        others = [F.lit(256 * i).cast("long") + _byte(i) for i in range(BYTES) if i not in positions]
        parts.append(F.when((F.col("set") == k) & (F.col("size") > long_list), F.array(*others)))
    numbered = rows.withColumn("set", F.shiftrightunsigned("key", 8 * len(sets[0])))
    return numbered.withColumn("part", F.explode(F.coalesce(*parts, F.array(F.lit(-1).cast("long")))))


def tallied(minor: DataFrame, every: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(a, b, ca, cb) of the pairs that meet in `least` or more lists: count filtering.

    minor (a, ca) and every (b, cb, major) are the two sides of each list; a pair is met from one end only. The lists it
    shares are collected as bits of one long, summed where the pair is made before pairs are dealt."""
    differ = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("major")) | (F.col("a") < F.col("b")))
    met = minor.join(every, keys).where(differ)
    low = F.col("a") < F.col("b")
    ends = [F.when(low, F.col(x)).otherwise(F.col(y)).alias(to) for x, y, to in (("a", "b", "a"), ("b", "a", "b"), ("ca", "cb", "ca"), ("cb", "ca", "cb"))]
    bits = met.select(*ends, F.expr("shiftleft(1L, cast(set as int))").alias("bit"))
    shared = bits.groupBy("a", "b").agg(F.bit_or("bit").alias("lists"), F.first("ca").alias("ca"), F.first("cb").alias("cb"))
    return shared.where(F.bit_count("lists") >= least).drop("lists")


def fingerprint_components(fps: DataFrame, max_bits: int = 4, key_bytes: int = KEY_BYTES, long_list: int = LONG) -> DataFrame:
    """(fp, root) for every distinct fingerprint of fps (fp, n): root is one fingerprint of its component.

    Fingerprints within max_bits share at least BYTES - max_bits positional bytes: the guaranteed matches. The index holds
    each distinct fingerprint under its bytes at sets of key_bytes positions (a list for a single positional byte would
    hold a 256th of all rows). First every list of a few sets links its members to the member with the most documents
    and to the one that holds the least value: in a crowd of near copies that joins nearly all, at two links a member. Then
    the index over all sets is tallied for the pairs whose ends are still in different components: in each list, members
    outside the list's largest component against all members, long lists pruned by one byte more. A pair with m equal
    bytes meets in as many lists as m bytes have sets, so those that meet in the number for the guaranteed matches are just
    the pairs with enough equal bytes; they are verified. No crowd is ever expanded into its pairs, and no pair between
    components is left out."""
    matches = BYTES - max_bits
    sets = position_sets(max_bits, key_bytes)
    lists = written(_postings(fps, sets, "n"), "postings")
    heads = lists.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max_by("fp", F.struct("n", "fp")).alias("most"), F.min("fp").alias("least")).where("size > 1")
    stars = lists.join(heads, "key").select("fp", F.explode(F.array_distinct(F.array("most", "least"))).alias("head"))
    links = _close(stars.where("fp <> head"), "fp", "head", max_bits).select(F.col("fp").alias("a"), F.col("head").alias("b")).distinct()
    first = written(connected_components(links), "near", instead_of=lists)

    size = len(sets[0])
    every_set = list(combinations(range(BYTES), size))
    named = fps.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("c"))
    again = written(_postings(named, every_set, "c"), "postings")
    parts = again.groupBy("key", "c").agg(F.count(F.lit(1)).alias("size"))
    several = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("size"), F.max_by("c", F.struct("size", "c")).alias("major")).where("parts > 1").drop("parts")
    within = again.join(several, "key")
    within = _pruned(within, every_set, long_list) if size < matches else within.withColumn("set", F.shiftrightunsigned("key", 8 * size)).withColumn("part", F.lit(-1))
    minor = within.where("c <> major").select("key", "part", F.col("fp").alias("a"), F.col("c").alias("ca"))
    every = within.select("key", "part", "set", F.col("fp").alias("b"), F.col("c").alias("cb"), "major")
    cross = _close(tallied(minor, every, ["key", "part"], comb(matches, size)), "a", "b", max_bits)
    second = connected_components(cross.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()).withColumnRenamed("node", "c")
    return named.join(second, "c", "left").select("fp", F.coalesce("component", "c").alias("root"))


def _rooted(prints: DataFrame, max_bits: int) -> DataFrame:
    """prints (doc_id, th, fp) with root, a fingerprint of the row's component, and component_id, its smallest doc_id."""
    prints = written(prints, "simhash")
    fps = written(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low")), "prints")
    named = written(fps.join(fingerprint_components(fps.select("fp", "n"), max_bits), "fp"), "roots")
    ids = named.join(named.groupBy("root").agg(F.min("low").alias("component_id")), "root")
    return prints.join(ids.select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle_words: int = 4, seed: int = 42, max_bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs: fingerprints link at max_bits or fewer differing bits.

    component_id is the smallest doc_id reachable through links, the document itself included. Documents with equal
    fingerprints meet as one row before any link is looked for. Null and empty texts have fingerprint 0 and are linked
    like others; repeated rows are kept; a null doc_id is no smallest id unless its whole component has none. Other
    columns of docs are not read. An empty table gives an empty result."""
    return _rooted(fingerprints(docs, shingle_words, seed), max_bits).select("doc_id", "fp", "component_id")


def text_hash() -> Column:
    """What tells rows of one id apart; a null text has a hash of its own."""
    return F.xxhash64(F.col("text").cast("string"), F.col("text").isNull())


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that stay, given found (doc_id, th, component): of each component the row with the smallest id, and
    of rows with that id the one with the least hash th of its text. Equal rows stay once; rows without an id are kept.

    Texts are dealt once, for the choice; once more only for rows that are repeated under one id with one text."""
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("r")).select("r.*")
    times = found.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    doc, th, own, n = fresh(docs.columns, "doc", "th", "own", "n")
    keep = written(first.join(times, ["doc_id", "th"]).select(F.col("doc_id").alias(doc), F.col("th").alias(th), F.col("n").alias(n)), "keep")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    met = docs.withColumn(own, text_hash()).join(keep, (F.col("doc_id") == F.col(doc)) & (F.col(own) == F.col(th)))
    out = met.where(F.col(n) == 1).select(*columns).unionByName(docs.where("doc_id is null"))
    if keep.where(F.col(n) > 1).isEmpty():
        return out
    return out.unionByName(met.where(F.col(n) > 1).dropDuplicates([doc, th]).select(*columns))


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that stay: of each component of `near_duplicates` one row, the one with the smallest id.

    Of rows that share the id but not the text, each component has its own, so none is lost; equal rows stay once; rows
    without an id are kept. All columns are kept under their names."""
    prints = fingerprints(docs.where("doc_id is not null"), how.get("shingle_words", 4), how.get("seed", 42))
    return one_of_each(docs, _rooted(prints, how.get("max_bits", 4)).withColumnRenamed("root", "component"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
