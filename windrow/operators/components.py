"""Connected components of links between numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.operators.tables import written

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b): component is the smallest node that can be reached.

    Each node points at the smallest one it knows of. In a round it hears from its neighbours, and then from the node that it
    points at, so that paths halve; rounds are written one by one. Only joins and minima: no neighbourhood is gathered."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    both = written(both, "neighbours")
    to = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component"))
    known = written(to, "components")
    for _ in range(MOST_ROUNDS):
        heard = both.join(known.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        # a node that is pointed at hears what those that point at it have heard
        up = known.join(heard, "node").select(F.col("component").alias("node"), "heard")
        least = heard.union(up).groupBy("node").agg(F.min("heard").alias("heard"))
        nearer = known.join(least, "node").select("node", F.col("component").alias("before"), F.least("component", "heard").alias("component"))
        shorter = nearer.join(nearer.select(F.col("node").alias("component"), F.col("component").alias("next")), "component").select("node", F.least("component", "next").alias("component"), "before")
        now = written(shorter, "components")
        known = now.select("node", "component")
        if now.where("component <> before").isEmpty():
            return known
    raise RuntimeError(f"components still change after {MOST_ROUNDS} rounds")
