"""Connected components of links between long ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterloom.llm.base import cut, free


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of the links (a, b); root is the smallest id of its component.

    Every round replaces each node's larger neighbours by links to its smallest one,
    then its smaller neighbours; the number of rounds grows with the logarithm of the
    longest path. Rounds read written tables, and only a count and a sum reach the driver.
    The result is a table of cut(). No links give no rows; links of a node to itself and nulls are left out.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state.n:
            out = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct())
            free(edges)
            return out
        seen = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = cut(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        free(edges, least)
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = cut(small.where("a <> b").distinct())
        free(large, low)
