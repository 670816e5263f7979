"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, beside, checkpoint


def with_least(edges: DataFrame, few: bool) -> DataFrame:
    """Edges (a, b) with m, the least b of their a; taken before a shuffle, so a hub's edges never meet in one task."""
    if few:
        return edges.join(F.broadcast(edges.groupBy("a").agg(F.min("b").alias("m"))), "a")
    return beside(edges, "a", {"m": F.min("b")}, "true")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (long columns a, b); root is the smallest node reachable.

    Each step takes a node's least neighbour before the shuffle and brings it back to the node's edges: by broadcast
    while the counted edges have at most ``FEW`` ends, else by a join that adaptive execution splits; so a hub's
    neighbours never meet in one task.  A round ends in the shared checkpoint folder.  Nothing but totals reaches the driver; not to settle in ``most_rounds`` is an error.
    Self-loops keep single nodes.
    """
    now = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    nodes = checkpoint(now.distinct())
    now, last = nodes.where("a <> b"), None
    few = 2 * nodes.count() <= FEW  # later rounds have no more ends than nodes
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, few).withColumn("m", F.least("a", "m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = with_least(large if few else checkpoint(large), few)
        small = low.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = checkpoint(small)
        total = now.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).collect()[0]
        if total == last or not total[0]:
            break
        last = total
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    every = nodes.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return every.join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
