"""Connected components by alternating large-star and small-star steps.

Every step is a minimum per node (combined before the shuffle) joined back to the edges. A hot node
has many edges and one minimum, so its partition is split by AQE's skew join, never gathered. Edges
are checkpointed in the shared folder after each round; only two numbers reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestrata.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every distinct node; component is the smallest node it reaches.

    nodes: (node), edges: (a, b) of the same type. Nulls and loops are ignored. Nodes without edges
    are their own component. Raises if it hasn't settled after most_rounds, which is far beyond the
    logarithm of any graph.
    """
    now = cut(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(now)
    for _ in range(most_rounds):
        now = cut(_small_star(_large_star(now)))
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components didn't settle")
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return nodes.where(F.col("node").isNotNull()).select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
