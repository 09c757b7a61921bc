"""Plans judged again as weights change, for all plans and versions at once.

Edges have versions with times of validity: (u, v, key, valid_from, weight), each in force
until the next of its edge. A plan is (id, source, target, depart_s, edge_path). Its legs
have times of entry, cumulated by a window from the weights that were in force when they
were last estimated. When a version comes, the plans on the way then are judged: a plan
stands at the first node that it reaches from then on; the rest of its way under the
weights in force is weighed against the best way under them, both thresholds of the gate
asked; and the rest is replaced, or timed anew. The best ways of all plans and versions
of a round come from one search or relaxation, a version being a scenario.

A round takes the next version of every plan that is on its way; there are as many rounds
as the most versions that one journey meets. Nothing is stepped.

A graph is searched for each time at which some journey is judged: where edges change one
by one all the time, round their times up to those at which weights are published.

A version that comes at departure or before is simply in force; one at arrival or later
is never met; one on the last leg is met too late to decide anything. Weights that are
null, and edges without a version in force, take `MISSING_S` on a plan and are not offered
by searches. Two versions of an edge at one time: the larger weight. Plans without edges
are left as they are. Ids are unique; null ids are dropped. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import materialize
from . import routing as R

# Fixed value, which results must share: seconds of an edge without a weight.
MISSING_S = 10.0
EDGE = ["u", "v", "key"]


def periods(changes: DataFrame) -> DataFrame:
    """u, v, key, weight, valid_from, valid_to (null: still in force)."""
    one = changes.groupBy(*EDGE, "valid_from").agg(F.max("weight").alias("weight"))
    return one.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(*EDGE).orderBy("valid_from")))


def in_force(rows: DataFrame, versions: DataFrame, at: str) -> DataFrame:
    """Adds to rows (u, v, key, ...) the weight in force at the time in column `at`: an as-of join on the edge."""
    known = versions.select(*(F.col(c).alias(f"_{c}") for c in (*EDGE, "valid_from", "valid_to")), "weight")
    same = [F.col(c) == F.col(f"_{c}") for c in EDGE]
    span = (F.col("_valid_from") <= F.col(at)) & (F.col("_valid_to").isNull() | (F.col(at) < F.col("_valid_to")))
    joined = rows.join(known, [*same, span], "left")
    return joined.drop(*(f"_{c}" for c in (*EDGE, "valid_from", "valid_to"))).withColumn("weight", F.coalesce("weight", F.lit(MISSING_S)))


def snapshots(versions: DataFrame, times: DataFrame, width: float) -> DataFrame:
    """scenario (the time as text), u, v, key, weight: the graph in force at each of the times (t). They meet in buckets of time."""
    ends = times.agg(F.floor(F.min("t") / width).alias("lo"), F.floor(F.max("t") / width).alias("hi")).first()
    if ends.lo is None:
        return versions.where("false").select(F.lit("").alias("scenario"), *EDGE, "weight")
    low, high = F.greatest(F.floor(F.col("valid_from") / width), F.lit(ends.lo)), F.least(F.coalesce(F.floor(F.col("valid_to") / width), F.lit(ends.hi)), F.lit(ends.hi))
    dealt = versions.where("weight is not null").withColumns({"_lo": low, "_hi": high}).where("_lo <= _hi").withColumn("_b", F.explode(F.sequence("_lo", "_hi")))
    met = dealt.join(times.withColumn("_b", F.floor(F.col("t") / width)), "_b").where("valid_from <= t and (valid_to is null or t < valid_to)")
    return met.select(F.col("t").cast("string").alias("scenario"), *EDGE, "weight")


def timed(legs: DataFrame) -> DataFrame:
    """entry_s of legs (id, i, start_s, weight): the start and the weights of the legs before."""
    w = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return legs.withColumn("entry_s", F.col("start_s") + F.coalesce(F.sum("weight").over(w), F.lit(0.0)))


def next_version(plans: DataFrame, times: DataFrame, width: float) -> DataFrame:
    """Adds t: the first of `times` after since_s and before arrival_s; plans without one are left out. They meet in buckets of time."""
    buckets = F.explode(F.sequence(F.floor(F.col("since_s") / width), F.floor(F.col("arrival_s") / width))).alias("_b")
    dealt = plans.select("id", "since_s", "arrival_s", buckets)
    met = dealt.join(times.withColumn("_b", F.floor(F.col("t") / width)), "_b").where("t > since_s and t < arrival_s")
    return plans.join(met.groupBy("id").agg(F.min("t").alias("t")), "id")


def rejudge(plans: DataFrame, changes: DataFrame, least_s: float, least_pct: float) -> tuple[DataFrame, DataFrame]:
    """(journeys, decisions).

    journeys: id, edge_path, depart_s, travel_s, n_versions, n_rerouted. decisions: id, t, at, leg, remaining_s,
    best_s, saving_s, saving_pct, triggered, of every version that a journey met; null `at` if it came too late.
    """
    versions = materialize(periods(changes))
    times = materialize(versions.select(F.col("valid_from").alias("t")).where("t is not null").distinct())
    plans = plans.where("id is not null")
    legs = plans.select("id", "target", "depart_s", F.posexplode("edge_path").alias("i", "e")).select("id", "target", "depart_s", F.col("depart_s").alias("start_s"), "i", "e.u", "e.v", "e.key")
    legs = timed(in_force(legs, versions, "depart_s")).withColumn("since_s", F.col("depart_s"))
    legs = materialize(legs.select("id", "target", "depart_s", "since_s", "i", *EDGE, "weight", "entry_s"))
    span = legs.groupBy("id").agg(F.sum("weight").alias("s")).agg(F.avg("s")).first()[0]
    width, done, log = max(span or 1.0, 1e-3), [], []
    while True:
        ends = legs.groupBy("id").agg(F.first("since_s").alias("since_s"), F.max(F.col("entry_s") + F.col("weight")).alias("arrival_s"))
        going = materialize(next_version(ends, times, width).select("id", "t"))
        done.append(legs.join(going, "id", "left_anti"))
        if going.isEmpty():
            break
        now = legs.join(going, "id")
        ahead = in_force(now.drop("weight").where("entry_s >= t"), versions, "t")
        first = Window.partitionBy("id")
        rest = materialize(ahead.withColumns({"_d": F.min("i").over(first), "start_s": F.min("entry_s").over(first)}))
        judged = rest.groupBy("id", "target", "t").agg(F.min("_d").alias("leg"), F.min_by("u", "i").alias("at"), F.sum("weight").alias("remaining_s"))
        asked = judged.select(F.col("t").cast("string").alias("scenario"), "id", "t", F.col("at").alias("source"), "target", "leg", "remaining_s")
        found = R.routes(asked, snapshots(versions, going.select("t").distinct(), width), counted=False)
        # A way that is blocked altogether stays.
        found = found.withColumn("best_s", F.coalesce("cost", "remaining_s")).withColumns(R.gate(F.col("remaining_s"), F.coalesce("cost", "remaining_s"), least_s, least_pct))
        found = materialize(found.select("id", "t", F.col("source").alias("at"), "leg", "remaining_s", "best_s", "saving_s", "saving_pct", "triggered", "edge_path"))
        log.append(going.join(found.drop("t", "edge_path"), "id", "left").withColumn("triggered", F.coalesce("triggered", F.lit(False))))
        kept = now.join(found.select("id", "leg"), "id", "left").where("leg is null or i < leg").select("id", "target", "depart_s", F.col("t").alias("since_s"), "i", *EDGE, "weight", "entry_s")
        stay = rest.join(found.where("not triggered").select("id"), "id").select("id", "target", "depart_s", "t", "start_s", "i", *EDGE, "weight")
        head = rest.where("i = _d").select("id", "target", "depart_s", "t", "start_s")
        turn = head.join(found.where("triggered").select("id", "leg", F.posexplode("edge_path").alias("j", "e")), "id").select("id", "target", "depart_s", "t", "start_s", (F.col("leg") + F.col("j")).alias("i"), "e.u", "e.v", "e.key")
        anew = timed(stay.unionByName(in_force(turn, versions, "t"))).select("id", "target", "depart_s", F.col("t").alias("since_s"), "i", *EDGE, "weight", "entry_s")
        legs = materialize(kept.unionByName(anew))
    every = union(done)
    decisions = union(log) if log else None
    kind = "id string, t double, at string, leg int, remaining_s double, best_s double, saving_s double, saving_pct double, triggered boolean"
    if decisions is None:
        decisions = plans.sparkSession.createDataFrame([], kind).withColumn("id", F.col("id").cast(plans.schema["id"].dataType))
    path = F.transform(F.array_sort(F.collect_list(F.struct("i", F.struct(*EDGE).alias("e")))), lambda x: x["e"])
    ends = every.groupBy("id").agg(path.alias("edge_path"), F.first("depart_s").alias("depart_s"), (F.max(F.col("entry_s") + F.col("weight")) - F.first("depart_s")).alias("travel_s"))
    met = decisions.groupBy("id").agg(F.count("*").alias("n_versions"), F.count_if("triggered").alias("n_rerouted"))
    idle = plans.where(F.size("edge_path") == 0).select("id", "edge_path", "depart_s", F.lit(0.0).alias("travel_s"))
    journeys = ends.unionByName(idle).join(met, "id", "left").fillna(0, ["n_versions", "n_rerouted"])
    return journeys, decisions


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
