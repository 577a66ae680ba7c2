"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node reachable.

    Alternating large-star and small-star rounds: each shuffles the current
    edges by node, takes each node's least neighbour by a partial aggregation
    (a node with a third of all edges costs no task more than its share) and
    relinks. Rounds grow with the logarithm of the longest chain. Each round is
    written to the shared folder, so a lost executor never replays the earlier
    ones. Edges with a null end and loops are ignored; a table without edges
    gives no rows.
    """
    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                       .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(least(both).withColumn("m", F.least("u", "m")), "u").where("v > u")
                     .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        large = written(large, "edges")
        low = least(large)
        small = (large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = written(small, "edges")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        mark = tuple(new)
