"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import drop_scratch, pin


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b longs); the root is the smallest node reachable.

    Each round hangs the larger neighbours of a node on its smallest neighbour, then its smaller ones,
    so the rounds follow the logarithm of the diameter.  Minima are counted in part before the
    shuffle, and the tables that are joined are written first, so Spark can split a hub with very many
    links over several tasks.  Links of a node to itself and repeated links change nothing; links with
    a NULL end are ignored; a node without other links has no row.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = pin(edges)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = pin(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
        large = both.where("b > a").join(low, "a").where("b <> low")
        large = pin(large.select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        low_too = pin(large.groupBy("a").agg(F.min("b").alias("low")))
        small = large.join(low_too, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = pin(small.unionByName(low_too.select("a", F.col("low").alias("b"))).distinct())
        seen = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        drop_scratch(spark, edges, low, large, low_too)
        edges = after
        if seen == before or seen[0] == 0:
            break
        before = seen
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
