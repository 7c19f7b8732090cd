"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens.llm.common import cut


def fresh(df: DataFrame, column: str) -> DataFrame:
    """The key under another expression, so that a join deals it out anew and can split a hot key."""
    return df.withColumn(f"{column}_k", F.xxhash64(column))


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over distinct edges (a, b), a > b.

    Large: every larger neighbour of a node is tied to the node's smallest one.
    Small: every smaller neighbour and the node itself are.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else edges
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    tied = (fresh(near, "a").join(fresh(least, "a").drop("a"), "a_k")
            .where(F.col("b") > F.col("a") if large else F.col("b") != F.col("m")).select("b", "m"))
    if not large:
        tied = tied.unionByName(least.select(F.col("a").alias("b"), "m"))
    return tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)`` of longs; the root is the smallest node reached.

    Alternates large-star and small-star (a logarithmic number of rounds in
    practice) until nothing changes. Every round is written to the checkpoint
    folder; neighbours are only ever aggregated, never listed. Self-loops,
    repeated edges and an empty table are fine.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if found == sign or not found[0]:
            break
        sign = found
        now = cut(star(star(now, True), False))
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
