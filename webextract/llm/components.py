"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, component): the smallest node that can be reached, for every node of an edge.

    Each round joins every node to the smallest of its neighbourhood and is written to the shared folder; the number of
    rounds grows with the logarithm of the longest path. Minima are aggregated before the shuffle, so a node of many edges
    costs no more than its edges. Pairs with a null, and nodes joined to themselves, are left out.
    """
    now = staged(
        edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    sign = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(low, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, staged(near.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        release(before)
        last, sign = sign, tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if sign == last:
            break
    roots = now.groupBy(F.col("b").alias("node")).agg(F.first("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
