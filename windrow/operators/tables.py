"""Names of helper columns, and tables written to be read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each lengthened until it is none of the taken ones, which Spark tells apart without regard to case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one, but only if driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or (spark.sparkContext.getCheckpointDir() or None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='windrow-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written into the shared folder and read again: what several results share is worked out once, and no lost
    executor makes it anew."""
    path = f"{shared_folder(df.sparkSession)}/windrow-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
