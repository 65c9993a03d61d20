"""Substring dedup: maximal repeats of words from prefix-partitioned suffix trees."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .repeats import Units, smaller_after, smaller_before, without_repeats

WORDS = 35


@dataclass
class Nodes:
    """Internal nodes of a suffix tree: leaves first, ..., last (in suffix order) share a path of `depth` units, and no more."""

    depth: np.ndarray
    first: np.ndarray
    last: np.ndarray


def internal_nodes(lcp: np.ndarray) -> Nodes:
    """The internal nodes of the tree over suffixes in order, from their common prefixes with the one before.

    Node and leaves are a maximal interval of the order whose neighbours share the node's depth or more, so its ends are
    the nearest smaller common prefixes on either side (Abouelhoda et al., 2004). The root of depth 0 is left out."""
    before, _ = smaller_before(lcp, lcp)
    after, _ = smaller_after(lcp, lcp)
    at = np.flatnonzero(lcp > 0)
    nodes = np.unique(np.stack([lcp[at], before[at], after[at] - 1], 1), axis=0) if len(at) else np.zeros((0, 3), np.int64)
    return Nodes(*nodes.T)


def _repeated(place: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
    """The leaves under internal nodes of `depth` or more."""
    nodes = internal_nodes(lcp)
    deep = nodes.depth >= depth
    edge = np.zeros(len(lcp) + 1, np.int64)
    np.add.at(edge, nodes.first[deep], 1)
    np.add.at(edge, nodes.last[deep] + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _drop(text: bytes, removed: np.ndarray) -> tuple[int, bytes]:
    own = text.split()
    return len(own), b" ".join(compress(own, (~removed[: len(own)]).tolist()))


def without_repeated_passages(docs: DataFrame, length: int = WORDS, anchor: int = 10, **limits: int) -> DataFrame:
    """(doc_id, n_units, n_removed, spans, kept): the words of each text that stay, joined by one space, in `kept`.

    A word goes if it is in a run of `length` words that starts anywhere else too, in the same document or another; every
    occurrence goes, and the input decides. Suffixes are split by prefixes of variable length into groups that fit a task:
    the prefix ends with the suffix's anchor, or is the whole run where an anchor is too common (see `repeats`, which also
    takes `limits`: split, piece). Each group's suffix tree has an internal node of depth `length` or more above every
    suffix that repeats; stretches that are equal as a whole hang from such a node by themselves, and only one of them is
    put into the tree. Runs do not cross documents.

    Null and empty texts have no words; very long texts are scanned in pieces; equal rows are repeats of each other, with or
    without a doc_id; other columns are not read; an empty table gives an empty result."""
    return without_repeats(docs, Units("words", length, anchor, earlier=False, **limits), _repeated, _drop)


def query(spark, sf_dir: str) -> DataFrame:
    out = without_repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
