"""Quality rules: length-normalised log-likelihood ratio of hashed n-grams between trusted texts and the raw corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ODD, Words, blocks, hashed, mixed, table, words, written

#: Buckets of the two multinomials: the only thing that is gathered on the driver, whatever the corpus' size.
BUCKETS = 1 << 15
#: The threshold lies under the lower quartile of held-out trusted documents by SPREADS of their interquartile ranges, and
#: by LEAST at least; scores are counted in steps of STEP up to REACH.
SPREADS, LEAST, STEP, REACH = 3.0, 0.1, 0.005, 12.0
#: Trusted ids are sent to every task up to so many (some 150 bytes each in memory); beyond, texts meet them by sort and merge.
SENT_IDS = 300_000
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30


def shapes(vocab: pa.Array) -> pa.Array:
    """The shape of each word: runs of capitals, small letters and digits become A, a and 0; other signs stay."""
    s = vocab.cast(pa.large_string())
    for pattern, to in ((r"\p{Lu}\p{Ll}+", "Aa"), (r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lo}\p{M}]+", "a"), (r"[0-9]+", "0")):
        s = pc.replace_substring_regex(s, pattern, to)
    return s


def ngram_buckets(w: Words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each word, word pair, word shape and pair of shapes; pairs do not cross rows."""
    word = hashed(w.vocab)
    shape = shapes(w.vocab).dictionary_encode()
    shape = hashed(shape.dictionary)[shape.indices.to_numpy(zero_copy_only=False)] if len(w.vocab) else word
    rows, last = w.rows, np.zeros(len(w.codes), bool)
    last[w.starts[1:][w.counts > 0] - 1] = True
    pair = np.flatnonzero(~last)
    one, two, parts, of = word[w.codes], shape[w.codes], [], []
    for k, h in enumerate((one, two)):
        parts += [mixed(h + np.uint64(ODD[k])), mixed(h[pair] * np.uint64(ODD[2]) + h[pair + 1] + np.uint64(ODD[k]))]
        of += [rows, rows[pair]]
    return (np.concatenate(parts) % np.uint64(buckets)).astype(np.int64), np.concatenate(of)


def _marked(docs: DataFrame, trusted: DataFrame, how: str) -> DataFrame:
    """(text, good, held_out) of docs, met with the trusted ids, of which a fifth by the id's CRC is held out."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    ids = written(ids.select("doc_id", F.lit(True).alias("good"), (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0).alias("held_out")), "trusted")
    # labels grow with the corpus, so only a checked number of ids is sent to every task
    small = F.broadcast(ids) if ids.count() <= SENT_IDS else ids.hint("merge")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(small, "doc_id", how)
    return rows.select("text", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("held_out", F.lit(False)).alias("held_out"))


def ngram_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over all documents and over the trusted ones that are not held out: two arrays of fixed length.

    Each task adds up its own documents, where they are read; sums by bucket follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for block in blocks(batches, "text"):
            bucket, row = ngram_buckets(words(block.column("text")), buckets)
            good = block.column("good").to_numpy(zero_copy_only=False).astype(bool) & ~block.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            total[0] += np.bincount(bucket, minlength=buckets)
            total[1] += np.bincount(bucket[good[row]], minlength=buckets)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "raw", "target"])

    sums = _marked(docs, trusted, "left").mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    got = sums.toArrow()  # at most `buckets` rows
    at = got.column("bucket").to_numpy()
    raw[at], target[at] = got.column("raw").to_numpy(), got.column("target").to_numpy()
    return raw, target


def _scores(w: Words, weights: np.ndarray) -> np.ndarray:
    """By row: the mean weight of its n-grams; 0 without any."""
    bucket, row = ngram_buckets(w, len(weights))
    n = len(w.counts)
    return np.bincount(row, weights[bucket] if len(row) else None, n) / np.maximum(1, np.bincount(row, minlength=n))


def _failed(w: Words, repeat: np.ndarray) -> np.ndarray:
    return (w.counts < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * w.counts)


def threshold_of(docs: DataFrame, trusted: DataFrame, weights: np.ndarray) -> float:
    """The least mean log-likelihood ratio of a document that is kept, from all held-out trusted documents: far
    below what they score, by the rule for far outliers (Tukey). Minus infinity if there are none.

    Scores are counted in steps, so the sums are exact and the same in every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(round(2 * REACH / STEP) + 1, np.int64)
        for block in blocks(batches, "text"):
            llr = _scores(words(block.column("text")), weights)
            total += np.bincount(np.rint((np.clip(llr, -REACH, REACH) + REACH) / STEP).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["step", "n"])

    rows = _marked(docs, trusted, "inner").where("held_out").select("text").mapInArrow(run, "step long, n long")
    got = rows.groupBy("step").agg(F.sum("n").alias("n")).toArrow().sort_by("step")  # a row for each step at most
    n, score = got.column("n").to_numpy(), got.column("step").to_numpy() * STEP - REACH
    if not len(n):
        return -math.inf
    low, high = (float(score[np.searchsorted(np.cumsum(n), q * n.sum())]) for q in (0.25, 0.75))
    return low - max(LEAST, SPREADS * (high - low))


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw), both smoothed by their share of the raw corpus plus one count."""
    base = (raw + 1) / (raw.sum() + len(raw))
    strength = 100.0
    return np.log((target + strength * base) / (target.sum() + strength)) - np.log(base)


def _repeat_words(w: Words, size: int) -> np.ndarray:
    """By row: words inside a window of `size` words that its own row holds twice or more."""
    n, counts = len(w.codes), w.counts
    if n < size:
        return np.zeros(len(counts), np.int64)
    code = mixed((w.codes + 1).astype(np.uint64))
    with np.errstate(over="ignore"):
        h = np.zeros(n - size + 1, np.uint64)
        for i in range(size):
            h = h * np.uint64(ODD[0]) + code[i : n - size + 1 + i]
        rows = w.rows
        inside = np.flatnonzero(rows[: n - size + 1] == rows[size - 1 :])
        key = mixed(h[inside]) + mixed(rows[inside].astype(np.uint64)) * np.uint64(ODD[1])
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    delta = np.zeros(n + 1, np.int64)
    at = inside[times[inverse] > 1]
    np.add.at(delta, at, 1)
    np.add.at(delta, at + size, -1)
    return np.bincount(rows[np.cumsum(delta[:-1]) > 0], minlength=len(counts))


def _dup_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def fitted(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float | None = None) -> tuple[np.ndarray, float]:
    """(weights by bucket, threshold); the threshold is derived from the held-out trusted documents unless it is given."""
    weights = log_ratio(*ngram_counts(docs, trusted, buckets))
    return weights, threshold_of(docs, trusted, weights) if threshold is None else threshold


def quality(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float | None = None) -> DataFrame:
    """One row per row of docs: base statistics, the base rules' verdict, the mean log-likelihood ratio `llr` of the
    text's hashed n-grams (trusted documents against all), and `kept`.

    A document is rejected by the base rules (under 20 words, or over 30 percent of its words in repeated 8-word
    windows), else kept if llr is the threshold or more (see `threshold_of`). Every document is decided alone, without
    chance. Null and empty texts have no words, llr 0, and fail; very long texts are read whole. If no document is trusted,
    every llr is 0 and the base rules decide. Repeated rows are judged alike; null doc_ids are kept and never trusted; other
    columns are not read; an empty table gives an empty result."""
    weights, least = fitted(docs, trusted, buckets, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            text = pc.fill_null(block.column("text"), "")
            w = words(text)
            n, rows = w.counts, w.rows
            chars = pc.utf8_length(w.vocab).to_numpy(zero_copy_only=False)
            chars = np.bincount(rows, chars[w.codes] if len(rows) else None, len(n)).astype(np.int64)
            symbols = pc.count_substring_regex(text, r"[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64)
            lines = np.array([_dup_lines(t) for t in text.to_pylist()], np.int64)
            repeat = _repeat_words(w, REPEAT_WINDOW)
            llr, failed = _scores(w, weights), _failed(w, repeat)
            columns = (n, chars, symbols, lines, repeat, failed, llr, ~failed & (llr >= least))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *map(pa.array, columns)], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def accepted(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float | None = None) -> DataFrame:
    """The rows of docs that `quality` keeps, with all their columns, in one pass after the counts: no join."""
    weights, least = fitted(docs, trusted, buckets, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            w = words(block.column("text"))
            yield block.filter(pa.array(~_failed(w, _repeat_words(w, REPEAT_WINDOW)) & (_scores(w, weights) >= least)))

    rows = docs.withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(run, rows.schema)


def trusted_ids(spark, sf_dir: str) -> DataFrame:
    """The trusted documents: those labelled of good quality and not toxic."""
    return table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))
