"""Connected components by alternating rounds of stars, for clusters of points within a distance and for near-duplicates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_root

#: Parts that a node's neighbours are dealt into, so that no task has to hold all those of a star's centre.
PARTS = 64
#: Edges to a file of a round's checkpoint; writing many files of few rows takes longer than the rows.
ROWS = 100_000


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage in the shared checkpoint folder."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (a, b) with m, the least of b by a: least by part first, then over a node's parts, of which it has PARTS."""
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int"))
    least = dealt.groupBy("a", "part").agg(F.min("b").alias("m")).withColumn("m", F.min("m").over(Window.partitionBy("a")))
    return dealt.join(least, ["a", "part"]).select("a", "b", "m")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b), root the smallest node reachable; loops and null ends are dropped.

    Each round moves every node's larger neighbours, then its smaller ones, to the smallest node near, and is
    checkpointed: few rounds, no path collected anywhere, and a node's neighbours spread over PARTS tasks. Edges that
    repeat count once; an edge table without rows gives none.
    """
    edges = checkpointed(edges.where("a <> b").select("a", "b").distinct())
    last = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if not state[0] or state == last:
            break
        last = state
        both = _with_least(edges.union(edges.select(F.col("b"), F.col("a"))))
        large = both.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = _with_least(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        moved = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = checkpointed(moved.distinct().coalesce(math.ceil(state[0] / ROWS)))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b"))).distinct()
