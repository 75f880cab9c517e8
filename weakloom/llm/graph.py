"""Connected components by alternating large and small stars, as joins and aggregations.

Each round points the neighbours of a node to the smallest node around; the number of rounds grows with the logarithm of the longest
chain. Only two numbers per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weakloom.llm.store import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(low.withColumnRenamed("m", "v")).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable from each node of ``links`` (``a, b``) that is not itself the smallest."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
        edges = stored(_small_star(_large_star(edges)), "edges")
