"""Shared helpers: tables, checkpoints in the shared folder, and vectorised words of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one block that a task works on at a time; keeps numpy's temporary arrays small.
BLOCK_ROWS = 1024
#: Bytes of text of one block, where a single row may exceed it.
BLOCK_BYTES = 6_000_000

ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one serves only where they are one process: elsewhere each
    executor would write to its own disk, and what is read again would lack the others' rows."""
    found = spark.conf.get("spark.checkpoint.dir", None) or (spark.sparkContext.getCheckpointDir() or None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='windrow-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str, instead_of: DataFrame | None = None, codec: str | None = None) -> DataFrame:
    """Writes a table into the shared folder and reads it again, so that its lineage is cut and a lost
    executor costs no recomputation. A table from an earlier call that this one makes useless is deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/windrow-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    if instead_of is not None:
        forget(instead_of)
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `written` made and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for old in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each lengthened until it is none of the taken ones, which Spark tells apart without regard to case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in blocks of bounded rows and, but for single long rows, bounded text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, base + most, side="right"))
            to = min(max(to, at + 1), at + BLOCK_ROWS, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """Words of a block of texts: codes into vocab, row by row; row r owns codes[starts[r]:starts[r + 1]]."""

    codes: np.ndarray
    starts: np.ndarray
    vocab: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)


def words(texts: pa.Array) -> Words:
    """Runs of characters other than space and U+0009 to U+000D; a null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists)
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(n)), n)[filled]
    starts = np.zeros(len(n) + 1, np.int64)
    np.cumsum(np.bincount(rows, minlength=len(n)), out=starts[1:])
    coded = flat.filter(pa.array(filled)).dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts, coded.dictionary)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashed(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(s) for s in strings.cast(pa.large_binary()).to_pylist()), np.uint64, len(strings))


def with_uid(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, text): uid orders the documents by doc_id and tells rows apart.

    It is doc_id where that is a key. Where ids are missing or repeated, rows are put in order of doc_id (null
    last) and text, and numbered in that order; equal rows count as separate documents."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1)
    if odd.isEmpty():
        return docs.select(F.col("doc_id").alias("uid"), "doc_id", "text")
    ordered = docs.sort(F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first())
    return written(ordered.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"), "uid")
