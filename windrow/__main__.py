"""Builds a dataset from local files, and its packages of analyses: python -m windrow OUT VERSION --air FILE [..]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from windrow.operators import packages
from windrow.sources import dataset, networks, readers

LAYERS = ("stations", "roads", "industries", "greens", "elevations")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("out", help="where the dataset is published")
    p.add_argument("version")
    p.add_argument("--air", required=True, help="CSV of measurements")
    p.add_argument("--meteo", help="CSV of weather")
    p.add_argument("--contexts", help="CSV of stations' surroundings")
    p.add_argument("--events", help="CSV of events")
    for name in LAYERS:
        p.add_argument(f"--{name}", help="JSON array")
    p.add_argument("--boundary", help="GeoJSON outline that the grid is clipped by")
    p.add_argument("--start", help="first day of the series that counts, YYYY-MM-DD")
    p.add_argument("--end", help="last day of the series that counts")
    p.add_argument("--packages", help="where packages of analyses are published; none are built without it")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    given = {n: readers.json_rows(spark, getattr(a, n), dataset.LAYER_SCHEMAS[n]) for n in LAYERS if getattr(a, n)}
    tables = dataset.built(spark, a.air, a.meteo, a.contexts, a.events, given.pop("stations", None)) | given
    day = F.to_date("ts")
    for end, keep in ((a.start, lambda x: day >= x), (a.end, lambda x: day <= x)):
        if end:
            tables[dataset.SERIES] = tables[dataset.SERIES].where(keep(F.lit(end).cast("date")))
    dataset.publish_dataset(tables, a.out, a.version)
    if not a.packages:
        return
    _, tables = dataset.current(spark, a.out, list(tables))
    boundary = networks.polygons(spark, a.boundary).select(F.concat(F.array("ring"), "holes").alias("rings")) if a.boundary else None
    inputs = dataset.package_inputs(tables, boundary)
    dataset.publish_packages(packages.build(inputs), a.packages, a.version, inputs.start, inputs.end)


if __name__ == "__main__":
    main()
