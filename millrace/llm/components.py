"""Connected components of a table of links by alternating large and small stars; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c


def connected(links: DataFrame, name: str = "components") -> DataFrame:
    """node, root for every node of links (columns a, b of any orderable type); root is the least node of the component.

    Each round rewrites the links as a table in the shared folder and halves the depth of what is not yet a star, so
    rounds grow with the logarithm of the longest path. Centres of large stars are joined by broadcast, so no task
    gathers a star. Null ends and loops are dropped.
    """
    e = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") > F.col("b")).distinct()
    e = c.written(e, name)
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = c.with_key(both, c.written(least, name), "a", 2 * mark[0]).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = c.written(large, name)
        root = c.written(large.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("m")), name)
        small = c.with_key(large, root, "a", mark[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") > F.col("b")).unionByName(root.select("a", F.col("m").alias("b"))).distinct()
        e = c.written(small, name)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(e: DataFrame) -> tuple:
    """Count and an order-free checksum of a table of links."""
    return tuple(e.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 20)), F.sum(F.xxhash64("b", "a").bitwiseAND(0xFFFFFFFF))).first())
