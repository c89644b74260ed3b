"""Connected components of an edge table, by DataFrame joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.operators.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the smallest node that it can reach.

    Alternates large-star and small-star steps: each node links its larger neighbours, then all its
    neighbours and itself, to the smallest of them. Edges never grow in number, and the rounds grow with
    the logarithm of the longest path. Every round is a stored table, so a lost executor costs one
    round. A node with many neighbours is one partial minimum per task.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # an edge points from the larger to the smaller node
    down = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()

    def large(e: DataFrame) -> DataFrame:
        near = both(e)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return down(near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))

    def small(e: DataFrame) -> DataFrame:
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        joined = e.join(least, "a")
        return down(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))))

    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = stage(down(edges), "edges")
    before, after = None, state(now)
    while before != after:
        now = stage(small(large(now)), "edges")
        before, after = after, state(now)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots).distinct()
