"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubwarden.llm.common import drop_staged
from hubwarden.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a long, b long); ``root`` is the smallest node it can reach.

    Every step joins on nodes; the edges are written after each pair of steps,
    so a lost executor costs one step; older ones are removed.  Loops, repeated and nulls edges are
    dropped.  Ends after about log(longest path) pairs of steps.
    """
    own = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    own, before = stage(own, "edges"), None
    while True:
        sums = own.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if sums == before:
            return own.select(F.col("u").alias("node"), F.col("v").alias("root")).union(own.select("v", "v").distinct())
        before = sums
        both = own.union(own.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # each lower neighbour and the node itself move to the lowest of them
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        older, own = own, stage(small.distinct(), "edges")
        drop_staged(own.sparkSession, older)
