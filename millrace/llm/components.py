"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import saved


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the edges (x, y).

    Alternating large-star and small-star: each round hangs a node's larger, then
    its smaller, neighbours on the smallest one it knows, until nothing changes.
    The minimum per node is a partial aggregate and the join that uses it can
    split a hot node.  Every round is written, so lineage stays one round long.
    """
    edges = saved(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u != v").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        edges = saved(small.union(lowest.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
