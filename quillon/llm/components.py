"""Connected components of links, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.kernels import written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of the nodes in links (a, b).

    Links are turned in rounds to a star around the least node: each node's neighbours, and the node itself, link to the
    least of them, first for the greater neighbours and then for the smaller ones. The rounds end when the links are
    stars; chains halve, so there are about log2(longest chain) of them. A node with very many neighbours is
    no group of its own in memory: its least neighbour comes from a sum that is combined before the shuffle, and goes
    back by a join that adaptive execution can split. Each round is written to the shared folder.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    for _ in range(most_rounds):
        if _are_stars(edges):
            break
        # large star: of every node, the greater neighbours link to the least of the node and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large-star")
        # small star: of every node, the smaller neighbours and itself link to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "small-star")
    else:
        raise RuntimeError("the links have a longer chain than the rounds allow")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Does every node link to one smaller node at most, and to none if others link to it?"""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1").isEmpty()
