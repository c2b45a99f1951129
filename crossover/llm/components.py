"""Connected components by alternating large-star and small-star steps, each a shuffle over the edges; nothing comes to the driver
but two sums a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossover.llm.common import written


def _star(edges: DataFrame, large: bool, name: str) -> DataFrame:
    """Large: each node links its larger neighbours to its least one. Small: its smaller neighbours and itself.

    The minima of the large step are a table of their own, so that the join gets both sides by plain exchanges and a hub with a third
    of all edges can be split.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
        out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return out.where("a > b").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable. Nodes are of any type with an order.

    Edges always point from a larger node to a smaller one. A hot node's list is never gathered: steps use a minimum by node,
    combined before the shuffle, and a join that adaptive execution can split.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), name)
    state = None
    while True:
        now = written(_star(_star(now, True, name), False, name), name)
        # A star forest no longer changes: as many edges as before, the same ones.
        after = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if after == state:
            break
        state = after
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("component")))
