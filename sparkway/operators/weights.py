"""Edge weights: static by road class, and per scenario from sensor speeds.

edges: u, v, key, length_m, highway. mapping: seg, u, v, key, policy (DYNAMIC,
DYNAMIC_BIDIRECTIONAL or STATIC_FALLBACK). speeds: scenario, seg, speed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kinematics as K

EDGE = ["u", "v", "key"]


def static_weights(edges: DataFrame) -> DataFrame:
    speed = K.class_speed(F.col("highway"))
    return edges.withColumn("static_speed", speed).withColumn("static_weight", K.travel_time(F.col("length_m"), F.col("static_speed")))


def dynamic_speeds(speeds: DataFrame, mapping: DataFrame, edges: DataFrame, lo: float = 3.0, hi: float = 120.0) -> DataFrame:
    """scenario, u, v, key, speed: means of the sensors on an edge, and on all parallel edges back where the policy says so."""
    known = speeds.join(mapping.where("policy <> 'STATIC_FALLBACK'"), "seg")
    direct = known.select("scenario", *EDGE, "speed")
    back = known.where("policy = 'DYNAMIC_BIDIRECTIONAL'").select("scenario", F.col("u").alias("_v"), F.col("v").alias("_u"), "speed")
    back = back.join(edges.select(*EDGE), (F.col("u") == F.col("_u")) & (F.col("v") == F.col("_v"))).select("scenario", *EDGE, "speed")
    return direct.unionByName(back).groupBy("scenario", *EDGE).agg(F.greatest(F.lit(lo), F.least(F.lit(hi), F.avg("speed"))).alias("speed"))


def scenario_weights(speeds: DataFrame, mapping: DataFrame, edges: DataFrame) -> DataFrame:
    """Every edge in every scenario: speed, weight, is_dynamic."""
    scenarios = speeds.select("scenario").distinct()
    base = static_weights(edges)
    dynamic = dynamic_speeds(speeds, mapping, edges).withColumnRenamed("speed", "_s")
    all_ = base.crossJoin(F.broadcast(scenarios)).join(dynamic, ["scenario", *EDGE], "left")
    speed = F.coalesce("_s", "static_speed")
    return all_.select("scenario", *EDGE, "length_m", speed.alias("speed"), F.when(F.col("_s").isNull(), F.col("static_weight")).otherwise(K.travel_time(F.col("length_m"), F.col("_s"))).alias("weight"), F.col("_s").isNotNull().alias("is_dynamic"))


def congest(weights: DataFrame, first: int, factor: float, order: str = "edge_ord") -> DataFrame:
    """Multiplies the weights of the first edges in order."""
    return weights.withColumn("weight", F.when(F.col(order) < first, F.col("weight") * factor).otherwise(F.col("weight")))
