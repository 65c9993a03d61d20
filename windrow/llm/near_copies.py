"""Near copies by exact Jaccard similarity of word shingles: candidates from SimHash bytes and MinHash bands, each verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import blocks, forget, mixed, written
from .components import connected_components

#: Documents are linked from a similarity of NUM / DEN on.
NUM, DEN = 4, 5
#: A band is the least values of ROWS hash functions; a pair at 0.8 shares none of the BANDS with chance (1 - 0.8^5)^27 = 0.00002,
#: and one at 0.25, of texts that share a passage, shares one with chance 0.03.
BANDS, ROWS = 27, 5
FACTORS = np.random.default_rng(7).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Lowest bits of BITS of the hash functions' least values: at 0.8 more than FAR of them differ with chance 0.0000003.
BITS, FAR = 128, 32
#: Turns, at most, in which members outside their lists' largest components are compared with one member of one of these.
TURNS = 8
#: They end with a turn that links under this share of its pairs: what is left then are not copies, but texts with a passage in common.
LEAST_LINKED = 0.1
#: Candidates of the byte index: fingerprints within so many bits.
MAX_BITS = 4


def _grams(h: np.ndarray) -> tuple[int, np.ndarray]:
    """A node's name and its set of shingles."""
    grams = np.unique(h.astype(np.uint64))
    return xxhash.xxh64_intdigest(grams.tobytes()), grams


def _least(grams: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 8192):
        np.minimum(least, (FACTORS[:, None] * grams[None, at : at + 8192]).min(axis=1), out=least)
    return least


def _bands(least: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(least[ROWS * b : ROWS * (b + 1)].tobytes(), b) for b in range(BANDS)], np.uint64)


def _bits(least: np.ndarray) -> np.ndarray:
    """One bit of each least value; the factors are odd, so the bits are taken from the middle of their hashes."""
    return np.packbits((mixed(least[:BITS]) & np.uint64(1)).astype(np.uint8)).view(np.uint64)


def _long(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    starts = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate([*rows, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)))


def _sketches(docs: DataFrame, shingle_words: int, seed: int) -> DataFrame:
    """(doc_id, th, node, size, fp, bits, bands): node names the document's set of shingles, size is how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            hashes = [simhash.shingles(t, shingle_words, seed) for t in block.column("text").to_pylist()]
            sets = [_grams(h) for h in hashes]
            least = [_least(g) for _, g in sets]
            columns = [block.column("doc_id"), block.column("th"), _long([n for n, _ in sets]), pa.array([len(g) for _, g in sets], pa.int64()), _long([simhash.majority(h) for h in hashes]), _lists([_bits(x) for x in least]), _lists([_bands(x) for x in least])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "node", "size", "fp", "bits", "bands"])

    return docs.withColumn("th", simhash.text_hash()).mapInArrow(run, "doc_id long, th long, node long, size long, fp long, bits array<long>, bands array<long>")


def _sets(docs: DataFrame, shingle_words: int, seed: int) -> DataFrame:
    """(node, grams): each document's set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            sets = [_grams(simhash.shingles(t, shingle_words, seed)) for t in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([_long([n for n, _ in sets]), _lists([g for _, g in sets])], ["node", "grams"])

    return docs.mapInArrow(run, "node long, grams array<long>")


def _may(a: str, b: str) -> Column:
    """Sizes that allow the similarity, and close fingerprints where the key is one of the byte index."""
    sizes = DEN * F.least(f"{a}.size", f"{b}.size") >= NUM * F.greatest(f"{a}.size", f"{b}.size")
    return sizes & (F.col("banded") | (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= MAX_BITS))


class _Known:
    """Sets of shingles of the nodes that were asked for so far, each read from its text and written once."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, shingle_words: int, seed: int) -> None:
        self.docs, self.nodes, self.how, self.tables = docs, nodes, (shingle_words, seed), []

    def of(self, ends: DataFrame) -> DataFrame:
        """(node, grams), among others of the ends (node)."""
        lack = ends.distinct()
        for df in self.tables:
            lack = lack.join(df.select("node"), "node", "left_anti")
        lack = written(lack, "ends")
        if not self.tables or not lack.isEmpty():
            ids = self.nodes.join(lack, "node").select(F.col("low").alias("doc_id")).distinct()
            sets = _sets(self.docs.join(ids, "doc_id", "left_semi"), *self.how).join(lack, "node", "left_semi").dropDuplicates(["node"])
            self.tables.append(written(sets, "sets"))
        forget(lack)
        out = self.tables[0]
        for df in self.tables[1:]:
            out = out.unionByName(df)
        return out


def _verified(pairs: DataFrame, known: _Known) -> DataFrame:
    """The pairs (a, b, ...) of nodes whose sets of shingles are as similar as asked for, written."""
    pairs = written(pairs, "candidates")
    sets = known.of(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))))
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b").join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
    alike = F.size(F.array_intersect("ga", "gb"))
    return written(both.where((NUM + DEN) * alike >= NUM * (F.size("ga") + F.size("gb"))).select(*pairs.columns), "linked", instead_of=pairs)


def _labelled(lists: DataFrame, named: DataFrame) -> DataFrame:
    """Members of lists with their node's component c."""
    return lists.withColumn("node", F.col("m.node")).join(named.select("node", "c"), "node").drop("node")


def _open(lists: DataFrame, turn: int) -> DataFrame:
    """The members of lists that hold several components, with major: the list's largest component and one member of it, which
    another turn, and another list, choose differently."""
    parts = lists.groupBy("key", "banded", "c").agg(F.count(F.lit(1)).alias("size"), F.min_by("m", F.xxhash64("m.node", "key", F.lit(turn))).alias("head"))
    several = parts.groupBy("key", "banded").agg(F.count(F.lit(1)).alias("parts"), F.max_by(F.struct("c", "head"), F.struct("size", "c")).alias("major"))
    return lists.join(several.where("parts > 1").drop("parts"), ["key", "banded"])


def components(docs: DataFrame, shingle_words: int, seed: int = 42) -> DataFrame:
    """(doc_id, th, root, component_id) for every row of docs with an id, th hashing its text: documents link at Jaccard
    NUM / DEN or more; component_id is the smallest id of a component, root what tells components apart.

    Documents with equal sets of shingles meet as one node first. Nodes are candidates if they share a MinHash band,
    or a key of SimHash's byte index at MAX_BITS or fewer differing bits; a 64-bit fingerprint alone can't do: at 0.8 it
    differs in about 10 bits and the index is complete up to 7. A list of candidates links its members to the member with
    the most documents and to the least; a member of many lists is compared with the head of the largest one alone. Near
    copies differ, so a crowd may not be alike enough to one head: turn by turn, each member outside its lists' largest components
    is compared with one member of one of these, a different one in each turn, until a turn links few of its pairs. Pairs are
    never more than members. Then all pairs that share a list and whose components are still different are compared, as in
    simhash.fingerprint_components, unless one bit of each of their least values already tells them apart. Each link is verified on the sets themselves, which are written once
    for the nodes of candidates."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = written(_sketches(docs, shingle_words, seed), "sketches")
    grouped = prints.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.min(F.struct("size", "fp", "bits", "bands")).alias("s"))
    nodes = written(grouped.select("node", "n", "low", "s.*"), "nodes")

    keys = F.concat("bands", F.array(*simhash.index_keys(simhash.position_sets(MAX_BITS))))
    member = F.struct("node", "size", "fp")
    lists = written(nodes.select("n", member.alias("m"), F.posexplode(keys).alias("k", "key")).select("key", (F.col("k") < BANDS).alias("banded"), "n", "m"), "lists")
    heads = lists.groupBy("key", "banded").agg(F.count(F.lit(1)).alias("_"), F.max_by("m", F.struct("n", "m")).alias("most"), F.min("m").alias("least")).where("_ > 1")
    stars = lists.join(heads, ["key", "banded"]).select("banded", "m", "_", F.explode(F.array_distinct(F.array("most", "least"))).alias("head"))
    stars = stars.where(F.col("m.node") != F.col("head.node")).where(_may("m", "head"))
    pairs = stars.groupBy(F.col("m.node").alias("a")).agg(F.max_by("head.node", F.struct("_", "head.node")).alias("b"))
    sets = _Known(docs, nodes, shingle_words, seed)
    linked = _verified(pairs, sets)
    first = connected_components(linked)

    named = written(nodes.join(first, "node", "left").select("node", "low", F.coalesce("component", "node").alias("c")), "named")
    again = written(_labelled(lists.select("key", "banded", "m"), named), "lists", instead_of=lists)
    forget(linked)
    within = written(_open(again, 0), "open", instead_of=again)
    for turn in range(1, TURNS + 1):
        heads = within.select("banded", F.col("m").alias("x"), F.col("c").alias("ca"), F.col("major.head").alias("y"), F.col("major.c").alias("cb")).where("ca <> cb").where(_may("x", "y"))
        one = F.min_by(F.struct(F.col("y.node").alias("b"), "cb"), F.xxhash64("x.node", "y.node", F.lit(turn)))
        pairs = heads.groupBy(F.col("x.node").alias("a"), "ca").agg(one.alias("one")).select("a", "one.b", "ca", "one.cb")
        pairs = written(pairs, "turn")
        linked = _verified(pairs, sets)
        found = connected_components(linked.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).withColumnRenamed("node", "c")
        named = written(named.join(found, "c", "left").select("node", "low", F.coalesce("component", "c").alias("c")), "named", instead_of=named)
        few = linked.count() <= LEAST_LINKED * pairs.count()
        forget(linked, pairs)
        within = written(_open(_labelled(within.select("key", "banded", "m"), named), turn), "open", instead_of=within)
        if few:
            break
    own = nodes.select(F.col("node").alias("_node"), *[F.col("bits")[i].alias(f"b{i}") for i in range(BITS // 64)])
    within = written(within.withColumn("_node", F.col("m.node")).join(own, "_node").drop("_node"), "open", instead_of=within)
    bits = [f"b{i}" for i in range(BITS // 64)]
    minor = within.where("c <> major.c").select("key", "banded", F.col("m").alias("x"), F.col("c").alias("ca"), *bits)
    every = within.select("key", "banded", F.col("m").alias("y"), F.col("c").alias("cb"), F.col("major.c").alias("major"), *[F.col(n).alias(f"y{n}") for n in bits])
    # both ends outside the major component: the pair is met from either end, one suffices
    differ = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("major")) | (F.col("x.node") < F.col("y.node"))) & _may("x", "y")
    differ &= sum(F.bit_count(F.col(n).bitwiseXOR(F.col(f"y{n}"))) for n in bits) <= FAR
    cross = minor.join(every, ["key", "banded"]).where(differ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), "ca", "cb").distinct()
    linked = _verified(cross, sets)
    second = connected_components(linked.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).withColumnRenamed("node", "c")
    roots = written(named.join(second, "c", "left").select("node", "low", F.coalesce("component", "c").alias("root")), "roots", instead_of=named)
    forget(linked, within, nodes, *sets.tables)
    ids = roots.join(roots.groupBy("root").agg(F.min("low").alias("component_id")), "root")
    return prints.select("doc_id", "th", "node").join(ids.select("node", "root", "component_id"), "node").select("doc_id", "th", "root", "component_id")


def deduplicated(docs: DataFrame, shingle_words: int) -> DataFrame:
    """The rows of docs that stay: of each component the document with the smallest id; all its columns are kept.

    Rows that share an id but not a text are separate documents; equal rows stay once; rows without an id are kept."""
    return simhash.one_of_each(docs, components(docs, shingle_words).select("doc_id", "th", F.col("root").alias("component")))
