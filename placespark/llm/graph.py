"""Connected components of links by alternating stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placespark.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links (a, b) reach from each node that has any.

    Large star: each node gives its larger neighbours the smallest of its neighbourhood; small star: each node does so
    for itself and its smaller neighbours. Both keep the components, and in a few rounds all that is left is stars.
    """
    edges = links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).filter("high > low")
    edges = stored(edges.distinct(), "links")
    before = None
    while True:
        both = edges.select(F.col("high").alias("u"), F.col("low").alias("v")).union(edges.select("low", "high"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()
        large = stored(large, "links")
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        joined = large.join(least, "high")
        small = joined.select("low", "m").union(least.select("high", "m")).toDF("high", "low")
        edges = stored(small.filter("high > low").distinct(), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first()
        if now == before:
            return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).union(
                edges.select("low", "low").distinct()
            )
        before = now
