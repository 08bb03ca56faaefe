"""Connected components of a large edge list, by rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsentry.llm.common import stored

MAX_ROUNDS = 60


def _nearest(links: DataFrame) -> DataFrame:
    """(`u`, `least`): the smallest of a node and its neighbours, from links (`u`, `v`)."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(`node`, `component`) of every node on an edge (`a`, `b` bigint); `component` is the smallest node reachable.

    Nodes on no edge, loops and nulls give no row. Each round is stored in the shared folder. A hub's links meet one row
    per node in a join, which adaptive execution splits; its least neighbour is summed before the shuffle. Rounds end when
    one gives the edges of the one before: count and a sum of hashes first, and if these agree, the edges themselves.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "edges")
    state = None
    for _ in range(MAX_ROUNDS):
        before = edges
        # Large star: every larger neighbour of u is linked to the least of u's neighbourhood.
        links = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        large = links.join(_nearest(links), "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = large.distinct()
        # Small star: u and its smaller neighbours are linked to the least of them.
        small = large.join(_nearest(large), "u")
        edges = small.filter("v > least").select(F.col("v").alias("a"), F.col("least").alias("b"))
        edges = edges.union(small.filter("u > least").select("u", "least")).distinct()
        edges = stored(edges, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 30))).first()
        if now == state and before.join(edges, ["a", "b"], "left_anti").isEmpty():  # both are distinct and equally many
            nodes = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
            return nodes.union(edges.select("b", "b").distinct())
        state = now
    raise RuntimeError("the components did not settle")
