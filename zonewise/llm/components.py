"""Connected components of a distributed edge list.

Alternating large-star and small-star rounds: every node learns the smallest node near it and hands it on, until nothing
changes (about log n rounds). Each round is one aggregation with partial sums and one join whose hot nodes Spark splits,
and is written to the shared folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.workset import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every node on the smallest of them (large: the greater neighbours; small: the others)."""
    if large:
        near = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    joined = near.join(least, near["a"] == least["node"])
    if large:
        return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("node").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (smallest node reachable) for every node with an edge to a smaller one; other nodes are their own component.

    ``edges`` has the columns a and b of one ordered type; loops, repeated and reversed edges are allowed, null ends are ignored.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b and b is not null").distinct()
    stars = scratch.settle(edges)
    before = None
    while True:
        both = _star(_star(stars, True), False).filter("a != b").distinct()
        new = scratch.settle(both)
        state = new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        scratch.drop(stars)
        stars = new
        if state == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
