"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertide.functions.runtime import forget, kept


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and component (its smallest node) for each node of the edges, whose columns a and b are of one orderable type.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest node it knows, until nothing changes. Each step is a
    grouped minimum, which Spark combines before it shuffles, and a join. Rounds grow with the logarithm of a component's size. Edges with
    a null end are left out; a node whose only edge is to itself is its own component.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    # From here on, a > b.
    held = kept(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := _state(held)) != before:
        before = now
        both = held.union(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        last, held = held, kept(small.distinct())
        forget(last)
    nodes = held.select(F.col("a").alias("node"), F.col("b").alias("component")).union(held.select("b", "b").distinct())
    alone = ends.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("component")).distinct().join(nodes.select("node"), "node", "left_anti")
    return nodes.union(alone)
