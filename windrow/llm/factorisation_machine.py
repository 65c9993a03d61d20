"""Quality classifier: a factorisation machine over hashed words, word shapes and structure statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, hashed, table, words
from .quality_rules import shapes

#: Hashed features; statistics have ids after them.
BUCKETS = 1 << 14
FACTORS = 6
#: At most so many labelled documents are fitted on, those with the least hash of their id.
SAMPLE = 4000
CUT = 0.3


def _sum_by(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, values, n) if len(rows) else np.zeros(n)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) in order of row: hashed words and shapes by damped share, then structure statistics."""
    w = words(texts)
    n, rows, size = w.counts, w.rows, np.maximum(1, w.counts)
    vocab = w.vocab.cast(pa.large_string())
    shape = shapes(vocab).dictionary_encode()
    shape_of = shape.indices.to_numpy(zero_copy_only=False)
    word = (hashed(vocab) % np.uint64(BUCKETS // 2)).astype(np.int64)
    form = (BUCKETS // 2 + (hashed(shape.dictionary) % np.uint64(BUCKETS // 2)).astype(np.int64))[shape_of] if len(vocab) else word
    key = np.concatenate([rows, rows]) * BUCKETS + np.concatenate([word[w.codes], form[w.codes]])
    key, times = np.unique(key, return_counts=True)
    row, feature = key // BUCKETS, key % BUCKETS
    value = np.sqrt(times / size[row])

    def of(per_word: np.ndarray) -> np.ndarray:
        return _sum_by(rows, per_word[w.codes], len(n))

    def counted(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(vocab, pattern).to_numpy(zero_copy_only=False).astype(float)

    chars = of(pc.utf8_length(vocab).to_numpy(zero_copy_only=False).astype(float))
    safe = np.maximum(1, chars)
    different = _sum_by(np.unique(rows * max(1, len(vocab)) + w.codes) // max(1, len(vocab)), None, len(n)) if len(rows) else np.zeros(len(n))
    text = pc.fill_null(texts, "")
    lines = pc.count_substring(text, "\n").to_numpy(zero_copy_only=False) + 1.0
    statistics = [
        np.ones(len(n)),
        np.log1p(n) / 8,
        chars / size / 8,
        different / size,
        of(counted(r"\p{Lu}")) / safe,
        of(counted(r"[0-9]")) / safe,
        of(counted(r"[#*$%&|<>!?]")) / safe * 4,
        of(counted(r"[^\p{L}\p{N}]$")) / size,
        lines / size,
        (n < 20).astype(float),
    ]
    k = len(statistics)
    extra = np.stack(statistics, 1)
    row = np.concatenate([row, np.repeat(np.arange(len(n)), k)])
    feature = np.concatenate([feature, np.tile(BUCKETS + np.arange(k), len(n))])
    value = np.concatenate([value, np.minimum(extra, 4).ravel()])
    order = np.argsort(row, kind="stable")
    return row[order], feature[order], value[order]


STATISTICS = 10


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """bias + sum w x + the weight of all pairs, in linear time: half of (sum v x)^2 - sum (v x)^2 by factor."""
        out = self.bias + _sum_by(row, self.linear[feature] * value, n)
        for f in range(self.factors.shape[1]):
            x = self.factors[feature, f] * value
            out += 0.5 * (_sum_by(row, x, n) ** 2 - _sum_by(row, x * x, n))
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(*features(texts), len(texts)), -30, 30)))


def fitted(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss and Adam steps over (features, values) of each document; the same rows give the same machine."""
    size = BUCKETS + STATISTICS
    chance = np.random.default_rng(seed)
    theta = np.concatenate([np.zeros((size, 1)), chance.normal(0, 0.05, (size, FACTORS))], 1)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    bias, first, second, step = float(np.log(share / (1 - share))), np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(epochs):
        order = chance.permutation(len(docs))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            feature = np.concatenate([docs[i][0] for i in own])
            value = np.concatenate([docs[i][1] for i in own])
            row = np.repeat(np.arange(len(own)), [len(docs[i][0]) for i in own])
            machine = Machine(bias, theta[:, 0], theta[:, 1:])
            error = (1 / (1 + np.exp(-np.clip(machine.margins(row, feature, value, len(own)), -30, 30))) - labels[own]) / len(own)
            vx = theta[feature, 1:] * value[:, None]
            sums = np.stack([_sum_by(row, vx[:, f], len(own)) for f in range(FACTORS)], 1)
            scale = (error[row] * value)[:, None]
            gradient = np.concatenate([scale, scale * (sums[row] - vx)], 1)
            used, back = np.unique(feature, return_inverse=True)
            total = np.stack([np.bincount(back, gradient[:, j], len(used)) for j in range(FACTORS + 1)], 1) + decay * theta[used]
            step += 1
            first[used] = 0.9 * first[used] + 0.1 * total
            second[used] = 0.99 * second[used] + 0.01 * total**2
            theta[used] -= rate * (first[used] / (1 - 0.9**step)) / (np.sqrt(second[used] / (1 - 0.99**step)) + 1e-8)
            bias -= rate * float(error.sum())
    return Machine(bias, theta[:, 0], theta[:, 1:])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine fitted on at most `sample` labelled documents (doc_id, quality) that are not held out; of rows that share an id
    the one with the least text.

    Features of the sample, not texts, reach the driver: a bounded number of rows. Without any label of either kind every
    score is the share of 1 among the labels (a half if there are none)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chosen = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            row, feature, value = features(block.column("text"))
            at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=block.num_rows))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (feature.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("quality"), *lists], ["doc_id", "quality", "feature", "value"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen.select("doc_id", F.col("quality").cast("int").alias("quality"))), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # one text for an id, so the bound holds
    got = rows.mapInArrow(run, "doc_id long, quality int, feature array<int>, value array<float>").toArrow().sort_by("doc_id")
    pairs = [(np.asarray(f, np.int64), np.asarray(v, float)) for f, v in zip(got.column("feature").to_pylist(), got.column("value").to_pylist(), strict=True)]
    return fitted(pairs, got.column("quality").to_numpy().astype(float))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Only the text is scored, whole, however long. Null and empty texts score by their statistics; repeated rows score alike; a null
    doc_id is not held out; other columns are not read; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            score = machine.scores(block.column("text"))
            columns = [block.column("doc_id"), block.column("held_out"), pa.array(score), pa.array((score >= CUT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
