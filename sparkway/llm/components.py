"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are joined to the least of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node itself, are joined to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a < b").distinct()


def connected(edges: DataFrame, scope: str = "default") -> DataFrame:
    """(node, comp): the least node that each node of an edge reaches. Rounds grow with the logarithm of the diameter."""
    now = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    before = None
    while True:
        now = materialize(small_star(large_star(now)), scope)
        sign = tuple(now.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first())
        if sign == before:
            break
        before = sign
    return now.select(F.col("b").alias("node"), F.col("a").alias("comp")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())
