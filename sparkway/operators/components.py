"""Connected and strongly connected components, projections and component statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize


def undirected(edges: DataFrame, length: str = "length_m") -> DataFrame:
    """One edge for each pair of end points, the shortest."""
    return edges.where("u <> v").groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min(length).alias(length), F.count("*").alias("n_edges"))


def weak(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component (its least node), by large-star / small-star rounds; `nodes` adds those without edges."""
    now = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a < b").distinct()
    sign = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(down.select(F.col("m").alias("x"), F.col("b").alias("y"))).where("x < y")
        now = materialize(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        new = tuple(now.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first())
        if new == sign:
            break
        sign = new
    ends = now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    if nodes is None:
        nodes = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    return nodes.join(ends, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _spread(label: DataFrame, edges: DataFrame) -> DataFrame:
    """Least label that reaches each node along `edges` (x, y)."""
    while True:
        pushed = label.withColumnRenamed("node", "x").join(edges, "x").select(F.col("y").alias("node"), F.col("c").alias("p")).groupBy("node").agg(F.min("p").alias("p"))
        new = materialize(label.join(pushed, "node", "left").select("node", F.least("c", F.coalesce("p", "c")).alias("c"), (F.coalesce("p", "c") < F.col("c")).alias("moved")))
        label = new.drop("moved")
        if new.where("moved").isEmpty():
            return label


def strong(edges: DataFrame) -> DataFrame:
    """node, component by colouring: forward spread of least labels, then what reaches each label's owner in its colour; the rest goes on."""
    left = materialize(edges.select(F.col("u").alias("x"), F.col("v").alias("y")).where("x <> y").distinct())
    nodes = materialize(edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct())
    done = None
    while not nodes.isEmpty():
        colour = _spread(nodes.select("node", F.col("node").alias("c")), left)
        same = left.join(colour.select(F.col("node").alias("x"), F.col("c").alias("cx")), "x").join(colour.select(F.col("node").alias("y"), F.col("c").alias("cy")), "y").where("cx = cy").select("x", "y")
        # Backward from each colour's owner, within the colour.
        back = materialize(same.select(F.col("y").alias("x"), F.col("x").alias("y")))
        seen = materialize(colour.where("node = c"))
        front = seen
        while True:
            front = materialize(front.withColumnRenamed("node", "x").join(back, "x").select(F.col("y").alias("node"), "c").distinct().join(seen, ["node", "c"], "left_anti"))
            if front.isEmpty():
                break
            seen = materialize(seen.unionByName(front))
        found = seen.select("node", F.col("c").alias("component"))
        done = found if done is None else done.unionByName(found)
        nodes = materialize(nodes.join(found, "node", "left_anti"))
        left = materialize(left.join(nodes.select(F.col("node").alias("x")), "x").join(nodes.select(F.col("node").alias("y")), "y"))
    return done if done is not None else nodes.select("node", F.col("node").alias("component"))


def sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("component").agg(F.count("*").alias("n_nodes"))


def largest_share(parts: DataFrame) -> DataFrame:
    """Number of components, nodes of the largest, and their share in percent."""
    return sizes(parts).agg(F.count("*").alias("components"), F.max("n_nodes").alias("largest"), (100.0 * F.max("n_nodes") / F.sum("n_nodes")).alias("largest_pct"))
