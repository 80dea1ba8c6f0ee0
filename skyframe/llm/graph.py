"""Connected components of an edge table by alternating large-star and small-star steps.

Each step replaces the neighbours of a node by links to their smallest member, so edges never multiply and a node with
any number of neighbours is handled by an aggregation and a join. Steps are stored, so that lineage stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skyframe.llm.common import cut


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the smallest node of its component. Loops and
    repeated edges are allowed; no edges: no rows."""
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    for _ in range(rounds):
        mark = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark == last:
            break
        last = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        now = cut(small.select("u", F.col("m").alias("v")).unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
                  .distinct(), "edges")
    pairs = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return cut(pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct()), "components")
