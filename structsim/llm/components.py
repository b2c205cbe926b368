"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structsim.llm.workspace import written


def connected_components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, root) of every node on an edge (a, b): root is the smallest node that it is connected to.

    Each step groups the edges by node and joins them with the least neighbour; a node with very many edges is split
    by the adaptive skew join. Every step's edges are written to the shared folder. Null nodes and loops are left out.
    """
    now = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), folder, f"{name}-0")
    step = 0
    while True:
        # Done when all edges are stars: each larger end has one edge and is no smaller end.
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("larger")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("larger")))
        of = ends.groupBy("node").agg(F.sum("larger").alias("larger"), F.count("*").alias("n"))
        if not of.where("larger > 1 or larger > 0 and n > larger").take(1):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        step += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), folder, f"{name}-{step}")
