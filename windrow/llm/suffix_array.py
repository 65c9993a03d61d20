"""Suffix-array dedup: longest previous factors of bytes over the whole corpus."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .repeats import Units, smaller_after, smaller_before, without_repeats

BYTES = 100


def longest_previous_factors(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For suffixes in order, their places in the corpus and common prefixes with the one before: the longest prefix of each
    that also starts at an earlier place.

    It is the greater of what the suffix shares with the nearest suffixes, before and after it in the order, whose places
    are smaller (Crochemore and Ilie, 2008)."""
    return np.maximum(smaller_before(place, lcp)[1], smaller_after(place, lcp)[1])


def _repeated(place: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
    return longest_previous_factors(place, lcp) >= depth


def _drop(text: bytes, removed: np.ndarray) -> tuple[int, bytes]:
    own = np.frombuffer(text, np.uint8)
    return len(own), own[~removed[: len(own)]].tobytes()


def without_earlier_copies(docs: DataFrame, length: int = BYTES, anchor: int = 24, **limits: int) -> DataFrame:
    """(doc_id, n_units, n_removed, spans, kept): what stays of each text's UTF-8 bytes, in `kept`.

    A byte goes if it is in a string of `length` bytes that also starts earlier: in a smaller doc_id, or earlier in the
    same document; overlaps count, and the input decides, not what is left. That is every position whose longest previous
    factor is `length` or more. Suffixes that can repeat are sorted in groups (see `repeats`, which also takes `limits`:
    split, piece), where previous and next smaller positions give the factors; of stretches that are equal as a whole only
    the first is sorted, for the factors of the others are known to reach over them. Strings do not cross documents.

    Null and empty texts have no bytes; very long texts are scanned in pieces; rows without a doc_id come last; rows that
    share a doc_id are in order of their texts, so of equal rows the first keeps its text; other columns are not read; an
    empty table gives an empty result."""
    return without_repeats(docs, Units("bytes", length, anchor, earlier=True, **limits), _repeated, _drop)


def query(spark, sf_dir: str) -> DataFrame:
    out = without_earlier_copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
