"""Steps over a network: the two best edges on, walks that all requests take together, and timelines of given paths.

Edges with a null weight are not left out here: give usable ones. Ties go to the smaller
(v, key). Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kinematics as K
from ..scratch import materialize

# Fixed values, which results must share: what a node seen, a turn back, a node without unseen neighbours and a node without edges cost.
VISITED_PENALTY, REVERSAL_PENALTY = 1000.0, 1e6
NO_WAY_ON, DEAD_END = 1e5, 1e6


def candidates(states: DataFrame, weights: DataFrame, most: int = 2, score=None) -> DataFrame:
    """The best `most` out-edges of each state (id, at, prev, visited); turning back only where nothing else is.

    Adds v, key, weight, n_out, n_eligible, rank, kind (dead_end, forced or
    choice). `score` is a column over the joined rows; the weight by default.
    """
    j = states.join(weights.select(F.col("u").alias("at"), "v", "key", "weight", "speed"), "at", "left")
    w = Window.partitionBy("id")
    back = F.col("v").eqNullSafe(F.col("prev"))
    j = j.withColumns({"n_out": F.count("v").over(w), "_fwd": F.sum(F.when(F.col("v").isNotNull() & ~back, 1).otherwise(0)).over(w)})
    j = j.where(~back | (F.col("_fwd") == 0) | F.col("v").isNull()).withColumn("n_eligible", F.when(F.col("_fwd") > 0, F.col("_fwd")).otherwise(F.col("n_out")))
    loop = F.array_contains("visited", F.col("v")).cast("int")
    j = j.withColumn("rank", F.row_number().over(w.orderBy(loop, score if score is not None else F.col("weight"), "v", "key")))
    kind = F.when(F.col("n_out") == 0, "dead_end").when(F.col("n_eligible") == 1, "forced").otherwise("choice")
    return j.where(F.col("rank") <= most).withColumn("kind", kind).drop("_fwd")


def random_order(state: str):
    """A score that orders a state's edges at random, but alike in every run."""
    return F.md5(F.concat(F.col(state).cast("string"), F.lit(">"), F.col("v"), F.lit("#"), F.col("key").cast("string")).cast("binary"))


def with_remaining(edges: DataFrame, nodes: DataFrame, free_kmh: float = 25.0) -> DataFrame:
    """Adds ahead_s: straight-line seconds from v to target (both joined with node, lat, lon)."""
    a, b = nodes.select(F.col("node").alias("v"), F.col("lat").alias("_y1"), F.col("lon").alias("_x1")), nodes.select(F.col("node").alias("target"), F.col("lat").alias("_y2"), F.col("lon").alias("_x2"))
    j = edges.join(a, "v", "left").join(b, "target", "left")
    return j.withColumn("ahead_s", K.remaining_time(F.col("_y1"), F.col("_x1"), F.col("_y2"), F.col("_x2"), free_kmh)).drop("_y1", "_x1", "_y2", "_x2")


def lookahead_two(edges: DataFrame, weights: DataFrame, nodes: DataFrame, fanout: int = 4, free_kmh: float = 25.0) -> DataFrame:
    """Adds look_s to edges (id, at, target, v, key, weight): weight plus the least of v's best `fanout` edges on and the rest of the way from there.

    Edges back to `at` don't count; at the target nothing is added. A node with no edge out costs DEAD_END, one with none to go on NO_WAY_ON.
    """
    nxt = weights.select(F.col("u").alias("v"), F.col("v").alias("_w"), F.col("key").alias("_key"), F.col("weight").alias("_n"))
    on = edges.select("id", "at", "target", "v", "key").join(nxt, "v")
    open_ = on.where("_w != at and _w != v").withColumn("_k", F.row_number().over(Window.partitionBy("id", "v", "key").orderBy("_n", "_w", "_key"))).where(F.col("_k") <= fanout)
    ahead = with_remaining(open_.select("id", F.col("v").alias("_v"), "key", "target", F.col("_w").alias("v"), "_n"), nodes, free_kmh)
    rest = F.when(F.col("v") == F.col("target"), 0.0).otherwise(F.coalesce("ahead_s", F.lit(0.0)))
    best = ahead.groupBy("id", F.col("_v").alias("v"), "key").agg(F.min(F.col("_n") + rest).alias("_n"))
    out = weights.select(F.col("u").alias("v")).distinct().withColumn("_out", F.lit(True))
    more = F.when(F.col("v") == F.col("target"), 0.0).when(F.col("_out").isNull(), DEAD_END).otherwise(F.coalesce("_n", F.lit(NO_WAY_ON)))
    return edges.join(best, ["id", "v", "key"], "left").join(out, "v", "left").withColumn("look_s", F.col("weight") + more).drop("_n", "_out")


def greedy_walk(requests: DataFrame, weights: DataFrame, nodes: DataFrame | None = None, alpha: float = 1.0) -> DataFrame:
    """All requests (id, source, target, max_hops) step together, a join a hop, until each has arrived, has no way on or has made its `max_hops`.

    The cheapest edge on, plus alpha times the rest of the way if `nodes` are given. A null
    target is never reached, and a null source has no way on; without `max_hops` no step is made.
    """
    state = materialize(requests.select("id", "source", "target", "max_hops", F.col("source").alias("at"), F.lit(None).cast("string").alias("prev"), F.array("source").alias("path"), F.lit(0.0).alias("cost"), F.lit(False).alias("stuck")))
    e = weights.select(F.col("u").alias("at"), "v", "key", "weight")
    going, done = "coalesce(at <> target, true) and not stuck and size(path) - 1 < coalesce(max_hops, 0)", []
    while True:
        # Those that have come to an end are set apart, and not written again.
        done.append(state.where(f"not ({going})"))
        state = state.where(going)
        if state.isEmpty():
            break
        j = state.select("id", "at", "prev", "path", "target").join(e, "at")
        base = F.col("weight")
        if nodes is not None:
            j = with_remaining(j, nodes)
            base = base + alpha * F.col("ahead_s")
        score = base + F.when(F.array_contains("path", F.col("v")), VISITED_PENALTY).otherwise(0.0) + F.when(F.col("v").eqNullSafe(F.col("prev")), REVERSAL_PENALTY).otherwise(0.0)
        pick = j.groupBy("id").agg(F.min(F.struct(score.alias("s"), "v", "key", "weight")).alias("_b"))
        moved, go = state.join(pick, "id", "left"), F.col("_b").isNotNull()
        state = materialize(moved.select("id", "source", "target", "max_hops", F.when(go, F.col("_b.v")).otherwise(F.col("at")).alias("at"), F.when(go, F.col("at")).otherwise(F.col("prev")).alias("prev"), F.when(go, F.concat("path", F.array("_b.v"))).otherwise(F.col("path")).alias("path"), (F.col("cost") + F.coalesce("_b.weight", F.lit(0.0))).alias("cost"), (~go).alias("stuck")))
    state = done[0]
    for more in done[1:]:
        state = state.unionByName(more)
    return state.select("id", "source", "target", "path", "cost", (F.size("path") - 1).alias("hops"), (F.col("at") == F.col("target")).alias("arrived"))


def timeline(journey: DataFrame, weights: DataFrame, keys: list[str], default_s: float = 10.0, default_m: float = 50.0) -> DataFrame:
    """A vehicle's progress: a row for each edge with elapsed seconds, metres and percent; edges unknown to `weights` take defaults."""
    legs = journey.select(*keys, F.posexplode("edge_path").alias("step", "_e")).select(*keys, "step", "_e.u", "_e.v", "_e.key")
    priced = legs.join(weights.select("u", "v", "key", "weight", "length_m"), ["u", "v", "key"], "left")
    w = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    return priced.select(*keys, "step", F.col("v").alias("node"), F.sum(F.coalesce("weight", F.lit(default_s))).over(w).alias("elapsed_s"), F.sum(F.coalesce("length_m", F.lit(default_m))).over(w).alias("distance_m"), (100.0 * (F.col("step") + 1) / F.count("*").over(all_)).alias("progress_pct"))
