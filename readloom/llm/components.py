"""Connected components by alternating large-star and small-star over DataFrames of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import staged


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # a table of its own: a join straight on an aggregate keeps its partitioning, and a hub's neighbours could not be split
    least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Edges come with u > v."""
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    onward = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return onward.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """``links(u long, v long)`` -> ``(node, component)``: every linked node with the smallest node reachable.

    Each round's edges are written to the shared folder, so a lost executor costs one round at most; nothing but two
    counters reaches the driver.  Self-links and repeated links are dropped; without links the result is empty.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = staged(edges, "edges")
    mark = None
    for _ in range(most):
        seen = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(seen) == mark or not seen["n"]:
            break
        mark = tuple(seen)
        edges = staged(_small(staged(_large(edges), "large")), "edges")
    else:
        raise RuntimeError(f"components did not settle within {most} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
