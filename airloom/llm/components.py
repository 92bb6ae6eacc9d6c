"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.sources.scratch import written


def _starred(edges: DataFrame, small: bool) -> DataFrame:
    """One star round over edges (a, b) with a > b.  Small: every node sends its smaller
    neighbours and itself to the least of them.  Large: it sends its larger ones there."""
    both = edges if small else edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if small:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    else:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node with an edge; root is the least node it reaches.

    edges: (a, b), any order.  A node's neighbours are never gathered; rounds grow with
    the logarithm of the longest path, and each is written to the shared folder."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def state(df):
        return df.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first()

    before = state(now)
    while before[0]:
        now = written(_starred(_starred(now, small=False), small=True), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
