"""Connected components of a graph held as a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One star step: each node's neighbours are linked to the smallest node around it."""
    pairs = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = pairs.join(least, "a")
    if large:
        out = joined.where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("a <> m").select("a", F.col("m").alias("b")))
    return out.distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014) reach the fixed point in a number of rounds
    that grows with the logarithm of the graph; each round is written to the shared folder in place of the one before. Nodes meet only in
    joins and sums, so a hub's links are never gathered in one place, and no part of the graph reaches the driver.
    Links with a null end and links of a node to itself are left out; ends need an order (numbers or strings)."""
    links = written(links.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        links = written(_stars(_stars(links, True), False), "links", instead_of=links)
        state = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.union(roots)
