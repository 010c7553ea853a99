"""Connected components by rounds of joins: every label becomes the smallest node that can be reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), root the smallest node of its component.

    Rounds of large-star and small-star: each node's larger neighbours are linked to the smallest of its
    neighbourhood, then its smaller ones, until nothing changes; the rounds grow with the logarithm of the component.
    Each round is a grouped minimum, which is summed up before the shuffle, and a join; a node with very many
    neighbours is split by the join. Nothing is gathered per node. Null ends and loops are left out; no edges, no rows.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = common.materialise(edges, "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small_least, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = common.materialise(small, "edges")
        same = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        if edges.agg(F.count("*"), same).first() == after.agg(F.count("*"), same).first():
            break
        edges = after
    roots = after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
