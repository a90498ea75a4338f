"""Connected components of a table of links, by large-star and small-star steps; no link or component leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodequarry.llm import shared


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node reachable) for every node that has a link to another; links are undirected.

    Rows with a null end and links of a node to itself say nothing. Each step hangs nodes from the smallest neighbour they know;
    minima are pre-aggregated and written before they are joined to the links, so that the links of a node with very many can be dealt to several tasks. The number of steps grows with the logarithm of the nodes."""
    tall = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    tall = shared.staged(tall, "links")
    while True:
        # done when every node hangs from one node and that one from none
        below = tall.groupBy("u").agg(F.count("*").alias("n"))
        if below.where("n > 1").isEmpty() and tall.select(F.col("v").alias("u")).join(below, "u", "left_semi").isEmpty():
            break
        both = tall.union(tall.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = shared.staged(least, "minima")
        large = both.where(F.col("v") > F.col("u")).join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = shared.staged(large, "large-star")
        least = shared.staged(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        tall = shared.staged(small.where(F.col("u") != F.col("v")).distinct(), "small-star")
    return tall.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tall.select("v", "v").distinct())
