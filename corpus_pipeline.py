"""The corpus pipeline: raw documents to packed training sequences, each stage an operator of windrow.llm.

Every stage's rows are written as Parquet into the shared folder and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from windrow.llm import line_templates, mixing, near_copies, packing, quality_rules
from windrow.llm.common import table, written

#: Near-duplicate stages of a pipeline compare shingles of five words.
SHINGLE_WORDS = 5


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.accepted(docs, quality_rules.trusted_ids(spark, sf_dir))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur in different texts go; a document of which nothing else is left goes too."""
    return line_templates.without_template_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at Jaccard 0.8 or more the one with the smallest id stays."""
    return near_copies.deduplicated(docs, shingle_words=SHINGLE_WORDS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their source's target asks for."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: No SQL: tokenisation and SimHash have none. tests/llm/test_pipeline.py holds run()'s rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
