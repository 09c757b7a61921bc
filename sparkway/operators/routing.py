"""Shortest paths, for all origins, destinations and scenarios at once.

`relax` works on DataFrames, with no graph in memory anywhere: labels are settled by
buckets of cost; settled labels are appended and never written again. Graphs that were
counted and found to have at most `MAX_EDGES` edges are sent to the executors as sorted
arrays, once, and searched there (`csr`): one search serves all targets of a source.
Both ways give the same rows: ties go to the smaller (u, key).

Edges with a null weight don't exist; weights of zero and under count as `LEAST`. A
source that is its own target costs 0 and visits 1 node. Unreachable targets have a null
cost and empty paths. Repeated requests each get a row. Null sources or targets reach
nothing. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kinematics as K
from ..scratch import materialize
from . import csr

#: Edges up to which a graph is sent to the executors: some 40 MB of arrays, and the names of its nodes.
MAX_EDGES = 2_000_000
#: Edges of a scenario up to which it is sent for searches that end at one target: 24 bytes an edge in a worker, some 300 MB.
POINT_EDGES, SCENARIOS = 12_000_000, 16
LEAST = 1e-4
REACH_NAMES = ["scenario", "source", "node", "cost", "pred_u", "pred_key"]
REACH_TYPES = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.int32())


def usable(weights: DataFrame) -> DataFrame:
    """Edges with a weight; none at or under zero."""
    return weights.where(F.col("weight").isNotNull()).withColumn("weight", F.when(F.col("weight") <= 0, LEAST).otherwise(F.col("weight")))


def bucket_width(edges: DataFrame) -> float:
    """Cost that one bucket spans: that of some eight edges, so that buckets are few and hold few labels twice."""
    return 8 * (edges.agg(F.avg("weight")).first()[0] or 1.0)


def relax(weights: DataFrame, sources: DataFrame, max_rounds: int | None = None, width: float | None = None) -> DataFrame:
    """scenario, source, node, cost, pred_u, pred_key, hops; weights: scenario, u, v, key, weight; sources: scenario, source.

    Open labels under the bucket's bound go out along their edges until none of them
    changes, then they are settled: appended as they are, and only asked after. What is
    written each round is the open labels alone. With `max_rounds` there is one bucket,
    and costs are the least of so many edges.
    """
    edges = materialize(usable(weights).select("scenario", "u", "v", "key", "weight"))
    keys, label = ["scenario", "source", "node"], ["cost", "pred_u", "pred_key", "hops"]
    width = float("inf") if max_rounds is not None else width or bucket_width(edges)
    kind = edges.schema["u"].dataType
    open_ = sources.where("source is not null").select("scenario", "source").distinct().select("scenario", "source", F.col("source").cast(kind).alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast(kind).alias("pred_u"), F.lit(None).cast("int").alias("pred_key"), F.lit(0).alias("hops"), F.lit(True).alias("fresh"))
    open_, settled, bound, rounds = materialize(open_), None, width, 0
    while True:
        least, going = open_.agg(F.min("cost"), F.count_if(F.col("fresh") & (F.col("cost") < bound))).first()
        if least is None or max_rounds is not None and rounds >= max_rounds:
            break
        if not going:
            done = materialize(open_.where(F.col("cost") < bound).select(*keys, *label))
            settled = done if settled is None else settled.unionByName(done)
            open_ = materialize(open_.where(F.col("cost") >= bound))
            least = open_.agg(F.min("cost")).first()[0]
            if least is None:
                break
            bound = (least // width + 1) * width
            continue
        rounds += 1
        now = F.col("fresh") & (F.col("cost") < bound)
        step = open_.where(now).withColumnRenamed("node", "u").join(edges, ["scenario", "u"]).select("scenario", "source", F.col("v").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"), F.col("u").alias("pred_u"), F.col("key").cast("int").alias("pred_key"), (F.col("hops") + 1).alias("hops"), F.lit(True).alias("fresh"))
        if settled is not None:
            step = step.join(settled.select(*keys), keys, "left_anti")
        # Of equal labels the one that has gone out already stays.
        both = open_.withColumn("fresh", F.col("fresh") & ~now).unionByName(step)
        open_ = materialize(both.groupBy(*keys).agg(F.min(F.struct(*label, "fresh")).alias("_s")).select(*keys, "_s.*"))
    rest = open_.select(*keys, *label)
    return rest if settled is None else settled.unionByName(rest)


def reach(weights: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """scenario, source, node, cost, pred_u, pred_key of all nodes that each source reaches; in memory if the graph is small enough."""
    ask = sources.where("source is not null").select("scenario", "source").distinct()
    built = csr.build(usable(weights).select("scenario", "u", "v", "key", "weight"), MAX_EDGES if limit is None else limit)
    if built is None:
        return relax(weights, ask).drop("hops")
    names, sent = built[0], ask.sparkSession.sparkContext.broadcast(built)

    def run(batches):
        names, arrays = sent.value
        for batch in batches:
            for s, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                i = number(names, a)
                if s not in arrays or i is None:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((s, a, a, 0.0, None, None), REACH_TYPES, strict=True)], names=REACH_NAMES)
                    continue
                g = csr.Arrays(*arrays[s])
                cost = csr.search(g, i)
                by = csr.predecessors(g, cost, i)
                at = np.flatnonzero(np.isfinite(cost))
                e = by[at]
                none = e < 0
                tail = np.searchsorted(g.first, e, "right") - 1
                cols = ([s] * len(at), [a] * len(at), names[at], cost[at], np.where(none, None, names[np.where(none, 0, tail)]), pa.array(g.key[np.where(none, 0, e)] if len(g.key) else np.zeros(len(at), np.int32), pa.int32(), mask=none))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, REACH_TYPES, strict=True)], names=REACH_NAMES)

    dealt = ask.repartition(ask.sparkSession.sparkContext.defaultParallelism, "scenario", "source")
    return dealt.select("scenario", "source").mapInArrow(run, "scenario string, source string, node string, cost double, pred_u string, pred_key int")


def trees(weights: DataFrame, targets: DataFrame, limit: int | None = None) -> DataFrame:
    """scenario, target, node, remaining_s, next_v, next_key: the cost from every node to each target, and the best route's first edge from there.

    One search over the edges turned round for each (scenario, target); ties go to the smaller (next_v, next_key).
    """
    turned = weights.select("scenario", F.col("v").alias("u"), F.col("u").alias("v"), "key", "weight")
    found = reach(turned, targets.select("scenario", F.col("target").alias("source")), limit)
    return found.select("scenario", F.col("source").alias("target"), "node", F.col("cost").alias("remaining_s"), F.col("pred_u").alias("next_v"), F.col("pred_key").alias("next_key"))


def reach_summary(weights: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """scenario, source, reached (nodes, itself included), farthest, mean_cost: `reach` summed up where it is searched, so that no label is written for graphs of up to `POINT_EDGES` edges."""
    ask = sources.where("source is not null").select("scenario", "source").distinct()
    built = csr.build(usable(weights).select("scenario", "u", "v", "key", "weight"), POINT_EDGES if limit is None else limit)
    if built is None:
        best = relax(weights, ask)
        return best.groupBy("scenario", "source").agg(F.count("*").alias("reached"), F.max("cost").alias("farthest"), F.avg("cost").alias("mean_cost"))
    sent = ask.sparkSession.sparkContext.broadcast(built)

    def run(batches):
        names, arrays = sent.value
        for batch in batches:
            rows = []
            for s, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                i = number(names, a)
                if s not in arrays or i is None:
                    rows.append((s, a, 1, 0.0, 0.0))
                    continue
                cost = csr.search(csr.Arrays(*arrays[s]), i)
                cost = cost[np.isfinite(cost)]
                rows.append((s, a, len(cost), float(cost.max()), float(cost.mean())))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64())
            names_ = ["scenario", "source", "reached", "farthest", "mean_cost"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names_)

    # More deals than cores: sources take unlike times.
    dealt = ask.repartition(4 * ask.sparkSession.sparkContext.defaultParallelism, "scenario", "source")
    return dealt.mapInArrow(run, "scenario string, source string, reached long, farthest double, mean_cost double")


def first_steps(requests: DataFrame, weights: DataFrame, steps: int, limit: int | None = None) -> DataFrame:
    """The rows of `trees` at the first `steps` nodes of each request's best way (scenario, source, target), and no others: one search a request, met from both ends."""
    ask = requests.select("scenario", "source", "target").distinct()
    turned = weights.select("scenario", F.col("v").alias("u"), F.col("u").alias("v"), "key", "weight")
    built = csr.build(usable(turned).select("scenario", "u", "v", "key", "weight"), POINT_EDGES if limit is None else limit)
    if built is None:
        tree = materialize(trees(weights, ask.select("scenario", "target").distinct(), 0))
        now, out = ask.select("scenario", "target", F.col("source").alias("node")), None
        for _ in range(steps):
            rows = now.distinct().join(tree, ["scenario", "target", "node"])
            out = rows if out is None else out.unionByName(rows)
            now = rows.where("next_v <> target").select("scenario", "target", F.col("next_v").alias("node"))
        return out.distinct()
    sent = ask.sparkSession.sparkContext.broadcast(built)

    def run(batches):
        names, arrays = sent.value
        ready = {}
        for batch in batches:
            rows = []
            for s, a, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                i, j = number(names, t), number(names, a)
                if a is not None and a == t:
                    rows.append((s, t, a, 0.0, None, None))
                if s not in arrays or i is None or j is None or i == j:
                    continue
                if s not in ready:
                    ready[s] = (g := csr.Arrays(*arrays[s])), csr.turned(g), csr.fine_width(g)
                g, back, width = ready[s]
                cost = csr.between(g, back, i, j, width)
                if np.isfinite(cost[j]):
                    for e in csr.way(g, back, cost, i, j)[::-1][:steps]:
                        rows.append((s, t, names[g.head[e]], float(cost[g.head[e]]), names[back.tail[e]], int(g.key[e])))
            kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.int32())
            names_ = ["scenario", "target", "node", "remaining_s", "next_v", "next_key"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names_)

    dealt = ask.repartition(2 * ask.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, "scenario string, target string, node string, remaining_s double, next_v string, next_key int").distinct()


def hop_bounded(weights: DataFrame, depth: int, fanout: int | None = None) -> DataFrame:
    """Simple paths of up to `depth` edges from every node, by unrolled joins: scenario, source, node, hops, cost, path."""
    e = usable(weights).select("scenario", "u", "v", "key", "weight")
    if fanout:
        from pyspark.sql.window import Window

        e = e.withColumn("_k", F.row_number().over(Window.partitionBy("scenario", "u").orderBy("weight", "v", "key"))).where(F.col("_k") <= fanout).drop("_k")
    now = e.select("scenario", F.col("u").alias("source"), F.col("v").alias("node"), F.lit(1).alias("hops"), F.col("weight").alias("cost"), F.array("u", "v").alias("path"))
    out = now
    for hop in range(2, depth + 1):
        now = now.join(e, (now.scenario == e.scenario) & (now.node == e.u)).where(~F.array_contains("path", F.col("v"))).select(now.scenario, "source", F.col("v").alias("node"), F.lit(hop).alias("hops"), (F.col("cost") + F.col("weight")).alias("cost"), F.concat("path", F.array("v")).alias("path"))
        out = out.unionByName(now)
    return out


EDGE_PATH = "array<struct<u:string,v:string,key:int>>"
ROUTE = f"cost double, visited int, is_reached boolean, node_path array<string>, edge_path {EDGE_PATH}"


def number(names: np.ndarray, node: str | None) -> int | None:
    """The place of a node among the names in order, if it is there."""
    if node is None:
        return None
    i = int(np.searchsorted(names, node))
    return i if i < len(names) and names[i] == node else None


def guide_speed(weights: DataFrame, nodes: DataFrame) -> float:
    """km/h of straight line that the best edge gains: the least speed at which the remaining line is never more than the remaining cost."""
    a, b = (nodes.select(F.col("node").alias(c), F.col("lat").alias(f"_y{c}"), F.col("lon").alias(f"_x{c}")) for c in "uv")
    metres = K.haversine(*(F.col(c) for c in ("_yu", "_xu", "_yv", "_xv")))
    top = usable(weights).join(a, "u").join(b, "v").agg(F.max(metres / F.col("weight") * 3.6)).first()[0]
    return max(3.6, (top or 0.0) * (1 + 1e-9))


def routes(requests: DataFrame, weights: DataFrame, nodes: DataFrame | None = None, guided: bool = False, limit: int | None = None, counted: bool = True) -> DataFrame:
    """Adds cost, visited, is_reached, node_path, edge_path to requests (scenario, source, target, ...).

    `visited` counts the nodes that a heap search settles before it ends; with `guided`
    (A*) by cost and the straight line at the speed of the edge that gains most (see
    `guide_speed`), so that costs stay least. `nodes`: node, lat, lon. Without `counted`
    it is null: searches then go from both ends, see far fewer nodes, and may be of graphs
    of up to `POINT_EDGES` edges a scenario; the other columns are the same.
    """
    speed = guide_speed(weights, nodes) / 3.6 if guided else None
    most = (MAX_EDGES if counted else POINT_EDGES) if limit is None else limit
    built = csr.build(usable(weights).select("scenario", "u", "v", "key", "weight"), most)
    if built is None and not counted:
        # Scenarios that are small enough on their own go one after the other.
        sizes = usable(weights).groupBy("scenario").agg(F.count("*").alias("n")).limit(SCENARIOS + 1).collect()
        if 1 < len(sizes) <= SCENARIOS and all(r.n <= most for r in sizes):
            kept = materialize(requests)
            own = [r.scenario for r in sizes]
            out = routes(kept.where(F.col("scenario").isNull() | ~F.col("scenario").isin(own)), weights.where("false"), nodes, counted=False)
            for s in own:
                out = out.unionByName(materialize(routes(kept.where(F.col("scenario") == s), weights.where(F.col("scenario") == s), nodes, guided, most, False)))
            return out
    if built is None:
        return by_relaxation(requests, weights, nodes, speed)
    names, at = built[0], np.full((2, len(built[0])), np.nan)
    if guided:
        # No more nodes than ends of edges are asked for.
        known = nodes.join(usable(weights).selectExpr("explode(array(u, v)) as node").distinct(), "node", "left_semi").dropna(subset=["lat", "lon"]).select("node", "lat", "lon").toArrow()
        i = np.searchsorted(names, known.column(0).to_numpy())
        at[:, i] = known.column(1).to_numpy(), known.column(2).to_numpy()
    sent = requests.sparkSession.sparkContext.broadcast((*built, at))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", " + ROUTE

    def lost(visited: int | None) -> tuple:
        return None, visited, False, [], []

    def answer(names, arrays, at, ready, s, a, targets):
        """Rows of one source's targets."""
        i = number(names, a)
        if s not in arrays or i is None:
            seen = int(a is not None) if counted else None
            return {t: (0.0, 1 if counted else None, True, [a], []) if a is not None and t == a else lost(seen) for t in targets}
        g, out = csr.Arrays(*arrays[s]), {}
        if not counted:
            if s not in ready:
                ready[s] = csr.turned(g), csr.fine_width(g)
            back, width = ready[s]
            for t in targets:
                j = number(names, t)
                guide = (lambda k, j=j: csr.straight(at[0], at[1], j, speed, k)) if guided and j is not None else None
                cost = None if j is None else csr.between(g, back, i, j, width, guide)
                if cost is None or not np.isfinite(cost[j]):
                    out[t] = lost(None)
                    continue
                e = csr.way(g, back, cost, i, j)
                path = [a, *names[g.head[e]].tolist()]
                out[t] = float(cost[j]), None, True, path, [{"u": x, "v": y, "key": int(k)} for x, y, k in zip(path, path[1:], g.key[e], strict=False)]
            return out
        ends = {t: number(names, t) for t in targets}
        known = np.array([x for x in ends.values() if x is not None], np.int64)
        cost = None if guided else csr.search(g, i, known if len(known) == len(ends) else None)
        by = None if guided else csr.predecessors(g, cost, i, cost[known].max(initial=0))
        for t, j in ends.items():
            h = None
            if guided and j is not None:
                h = csr.straight(at[0], at[1], j, speed)
                cost = csr.search(g, i, np.array([j]), h)
                by = csr.predecessors(g, cost, i, cost[j])
            elif guided:
                cost = csr.search(g, i)
            if j is None or not np.isfinite(cost[j]):
                out[t] = lost(int(np.isfinite(cost).sum()))
                continue
            e = csr.path(g, by, i, j)
            path = [a, *names[g.head[e]].tolist()]
            out[t] = float(cost[j]), csr.settled(cost, j, h), True, path, [{"u": x, "v": y, "key": int(k)} for x, y, k in zip(path, path[1:], g.key[e], strict=False)]
        return out

    def run(parts):
        names, arrays, at = sent.value
        ready = {}
        for p in parts:
            p = p.reset_index(drop=True)
            found = [None] * len(p)
            for (s, a), q in p.groupby(["scenario", "source"], dropna=False, sort=False):
                rows = answer(names, arrays, at, ready, s if isinstance(s, str) else None, a if isinstance(a, str) else None, dict.fromkeys(q["target"]))
                for at_row, t in zip(q.index, q["target"], strict=True):
                    found[at_row] = rows[t]
            yield pd.concat([p, pd.DataFrame(found, columns=["cost", "visited", "is_reached", "node_path", "edge_path"]).astype({"visited": "Int32"})], axis=1)

    # Requests of one source come together; those of a source that many have are cut by target.
    dealt = requests.repartitionByRange(requests.sparkSession.sparkContext.defaultParallelism, "scenario", "source", "target")
    return dealt.mapInPandas(run, schema)


def by_relaxation(requests: DataFrame, weights: DataFrame, nodes: DataFrame | None = None, metres_per_s: float | None = None) -> DataFrame:
    """The same without the graph in memory: relaxation, then the paths followed back a join a hop."""
    best = materialize(relax(weights, requests.select("scenario", "source").distinct()))
    keys = ["scenario", "source", "target"]
    ends = materialize(requests.select(*keys).distinct().join(best.select("scenario", "source", F.col("node").alias("target"), "cost"), keys, "left"))
    every = ends.join(best.select("scenario", "source", "node", F.col("cost").alias("_c")), ["scenario", "source"])
    f, end = F.col("_c"), F.col("cost")
    if metres_per_s is not None:
        a, b = (nodes.select(F.col("node").alias(n), F.col("lat").alias(f"_y{n}"), F.col("lon").alias(f"_x{n}")) for n in ("node", "target"))
        every = every.join(a, "node", "left").join(b, "target", "left")
        f = f + F.coalesce(K.haversine(F.col("_ynode"), F.col("_xnode"), F.col("_ytarget"), F.col("_xtarget")) / metres_per_s, F.lit(0.0))
    before = end.isNull() | (f < end) | (f == end) & (F.col("node") <= F.col("target"))
    counted = every.where(before).groupBy(*keys).agg(F.count("*").cast("int").alias("visited"))
    empty = F.expr(f"cast(array() as {EDGE_PATH})")
    walk = materialize(ends.withColumns({"at": F.when(F.col("cost").isNotNull(), F.col("target")), "edge_path": empty}))
    steps, arrived = best.select("scenario", "source", F.col("node").alias("at"), "pred_u", "pred_key"), []
    while True:
        arrived.append(walk.where("at is null or at = source").drop("at"))
        walk = walk.where("at <> source")
        if walk.isEmpty():
            break
        edge = F.array(F.struct(F.col("pred_u").alias("u"), F.col("at").alias("v"), F.col("pred_key").alias("key")))
        walk = materialize(walk.join(steps, ["scenario", "source", "at"]).withColumns({"edge_path": F.concat(edge, "edge_path"), "at": F.col("pred_u")}).drop("pred_u", "pred_key"))
    done = arrived[0]
    for more in arrived[1:]:
        done = done.unionByName(more)
    path = F.concat(F.array("source"), F.transform("edge_path", lambda e: e["v"]))
    seen = counted.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.col("scenario").eqNullSafe(F.col("_scenario")) & F.col("source").eqNullSafe(F.col("_source")) & F.col("target").eqNullSafe(F.col("_target"))
    done = done.join(seen, same, "left").select(*keys, "cost", F.coalesce("visited", F.when(F.col("source").isNull(), 0).otherwise(1)).alias("visited"), F.col("cost").isNotNull().alias("is_reached"), F.when(F.col("cost").isNotNull(), path).otherwise(F.expr("cast(array() as array<string>)")).alias("node_path"), "edge_path")
    both, row = requests.alias("r"), done.alias("d")
    same = F.col("r.scenario").eqNullSafe(F.col("d.scenario")) & F.col("r.source").eqNullSafe(F.col("d.source")) & F.col("r.target").eqNullSafe(F.col("d.target"))
    return both.join(row, same, "left").select("r.*", *(F.col(f"d.{c}") for c in ("cost", "visited", "is_reached", "node_path", "edge_path")))


def path_cost(paths: DataFrame, weights: DataFrame, keys: list[str], name: str, value: str = "weight", default: float = 0.0, path: str = "edge_path") -> DataFrame:
    """Sum of a column of `weights` (u, v, key, value) along each path; edges without one count `default`."""
    legs = paths.select(*keys, F.explode(path).alias("_e")).select(*keys, "_e.u", "_e.v", "_e.key")
    priced = legs.join(weights.select("u", "v", "key", F.col(value).alias("_w")), ["u", "v", "key"], "left")
    sums = priced.groupBy(*keys).agg(F.sum(F.coalesce("_w", F.lit(default))).alias(name))
    return paths.join(sums, keys, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of two edge lists as sets; two empty ones are equal."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)), n))


def gate(remaining: Column, best: Column, least_s: float | Column, least_pct: float | Column) -> dict[str, Column]:
    """The two-threshold reroute gate: saving, its share, and whether both thresholds are met."""
    saving = remaining - best
    pct = F.coalesce(F.try_divide(saving, remaining) * 100, F.lit(0.0))
    return {"saving_s": saving, "saving_pct": pct, "triggered": (saving >= least_s) & (pct >= least_pct)}


def gate_failure(saving: Column, pct: Column, least_s: float, least_pct: float) -> Column:
    t, p = saving >= least_s, pct >= least_pct
    return F.when(t & p, "triggered").when(~t & ~p, "both").when(~t, "time_only").otherwise("percent_only")


def decision_index(n: Column, share: float | Column) -> Column:
    """Edge number at which a journey of n edges is reconsidered."""
    return F.greatest(F.lit(1), F.least(F.floor(n * share).cast("int"), n - 2))


def replay(planned: DataFrame, predicted: DataFrame, observed: DataFrame, share: float, least_s: float, least_pct: float) -> DataFrame:
    """Journeys planned on predicted weights, reconsidered on the way under observed ones.

    planned: od, source, target, edge_path. Predicted and observed: u, v, key,
    weight. The part already driven is costed as predicted, the rest as
    observed; the route is changed if the gate says so.
    """
    n = F.size("edge_path")
    j = planned.where(n >= 2).withColumn("k", decision_index(n, share))
    j = j.withColumns({"prefix": F.slice("edge_path", 1, F.col("k")), "suffix": F.slice("edge_path", F.col("k") + 1, n)}).withColumn("at", F.col("suffix")[0]["u"])
    j = path_cost(j, predicted, ["od"], "prefix_s", path="prefix")
    j = path_cost(j, observed, ["od"], "remaining_s", path="suffix")
    again = routes(j.select(F.lit("observed").alias("scenario"), "od", F.col("at").alias("source"), "target"), observed.withColumn("scenario", F.lit("observed")))
    j = j.join(again.select("od", F.col("cost").alias("best_s"), F.col("edge_path").alias("best_path")), "od")
    j = j.withColumns(gate(F.col("remaining_s"), F.col("best_s"), least_s, least_pct))
    final = F.when(F.col("triggered"), F.concat("prefix", "best_path")).otherwise(F.col("edge_path"))
    total = F.col("prefix_s") + F.when(F.col("triggered"), F.col("best_s")).otherwise(F.col("remaining_s"))
    return j.withColumns({"no_reroute_s": F.col("prefix_s") + F.col("remaining_s"), "dynamic_s": total, "overlap": jaccard("edge_path", final), "changed_edges": F.size(F.array_except(final, F.col("edge_path")))})
