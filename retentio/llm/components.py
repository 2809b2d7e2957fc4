"""Connected components of a table of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frozen


def _fingerprint(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 16))).first()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest node) for every node of ``links``.

    Rounds of two steps, until the table of edges stays the same: each node's
    larger neighbours, then its smaller ones, are linked to its smallest.  The
    number of rounds grows with the logarithm of the nodes, and a round writes
    its edges, so a lost executor costs one round at most.
    """
    edges = frozen(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    before = None
    while (now := _fingerprint(edges)) != before and now[0]:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
                 .distinct())
        small = large.groupBy("a").agg(F.min("b").alias("least"))
        edges = frozen(large.join(small, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
                       .unionByName(small.select("a", F.col("least").alias("b"))).distinct())
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
