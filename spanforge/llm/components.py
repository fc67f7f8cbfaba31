"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): for each node of links (u, v), the smallest node it can reach.

    Both stars take a minimum per node, combined in the map tasks, and join it
    back to the links, so a node with very many links is never gathered in a
    task.  Each round is written to the shared folder.
    """
    edges = scratch.keep(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def star(found: DataFrame) -> DataFrame:
        both = found.union(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        # u's smaller neighbours and u itself now point to the smallest of them
        joined = large.join(down, "u")
        small = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        return small.union(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()

    def state(found: DataFrame) -> tuple:
        return tuple(found.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.countDistinct("u")).first())

    before = state(edges)
    while before[0]:
        edges = scratch.keep(star(edges), "edges")
        now = state(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
