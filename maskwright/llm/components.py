"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) of every node of the edges (a, b), ``root`` its component's smallest node.

    Each round joins every node's neighbours to its smallest one, first those
    above it, then those below; the edges end as stars. Rounds grow with the
    logarithm of a component's diameter; a node with many neighbours is a
    large key of one join, which adaptive execution splits. Raises if so many
    ``rounds`` do not settle the edges.
    """
    now = stored(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where(F.col("a") != F.col("b")).distinct(), "stars")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "stars")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
