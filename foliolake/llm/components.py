"""Connected components of a table of links, by alternating large and small stars; no link leaves the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Links of a node from which on its rows are joined where they stand; there are at most one in ``HOT`` links of such nodes.
HOT = 100_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of a link reaches. Nodes without links aren't listed."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = written(edges, "links")
    mark = _mark(edges)
    while True:
        # Large star: every larger neighbour of a node is tied to the smallest one it can see.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        up = both.where("v > u")
        if mark[0] < HOT:  # no node can have so many links
            tied = up.join(least.drop("n"), "u")
        else:
            hot = F.broadcast(least.where(F.col("n") >= HOT).drop("n"))
            tied = up.join(hot, "u").unionByName(up.join(hot, "u", "left_anti").join(least.where(F.col("n") < HOT).drop("n"), "u"))
        large = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours of a node, and the node, are tied to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = written(small, "links")
        now = _mark(new)
        forget(edges)
        if now == mark:
            break
        edges, mark = new, now
    tips = new.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return tips.unionByName(tips.select(F.col("component").alias("node"), "component")).distinct()
