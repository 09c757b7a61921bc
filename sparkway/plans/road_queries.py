"""Routing queries over the nation trade graph of the driver's tables.

An edge joins a customer's nation to a supplier's, one for each return flag, its
length a mean quantity. Sensors are users
of `events`, mapped onto edges in turn; odd hours are what was observed, even
hours what was predicted.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kinematics as K
from ..operators import evaluation as V
from ..operators import routing as R
from ..operators import walk as S
from ..operators import weights as G
from ..scratch import materialize
from .registry import query, rounded, table

HIGHWAY = ["motorway", "primary", "secondary", "tertiary", "residential"]


def edges(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier", "nation")}
    j = t["lineitem"].select("l_orderkey", "l_suppkey", "l_returnflag", "l_quantity").join(t["orders"].select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    j = j.join(t["customer"].select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(t["supplier"].select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").where("c_nationkey <> s_nationkey")
    e = j.groupBy(F.col("c_nationkey").alias("cu"), F.col("s_nationkey").alias("cv"), F.col("l_returnflag").alias("f")).agg((F.avg("l_quantity") * 100).alias("length_m"))
    kind = F.lit(HIGHWAY[4])
    for i in range(4):
        kind = F.when(F.col("n_regionkey") == i, HIGHWAY[i]).otherwise(kind)
    e = e.join(F.broadcast(t["nation"].select(F.col("n_nationkey").alias("cu"), "n_regionkey")), "cu")
    pad = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    return materialize(e.select(pad("cu").alias("u"), pad("cv").alias("v"), F.when(F.col("f") == "A", 0).when(F.col("f") == "N", 1).otherwise(2).alias("key"), "length_m", kind.alias("highway"), (F.row_number().over(Window.orderBy("cu", "cv", "f")) - 1).alias("edge_ord")))


def mapping(spark, sf_dir, e):
    n = e.count()
    segs = table(spark, sf_dir, "events").select(F.col("user_id").alias("seg")).distinct()
    policy = F.when(F.col("seg") % 3 == 0, "DYNAMIC").when(F.col("seg") % 3 == 1, "DYNAMIC_BIDIRECTIONAL").otherwise("STATIC_FALLBACK")
    return segs.withColumn("edge_ord", (F.col("seg") % n).cast("int")).withColumn("policy", policy).join(e.select("edge_ord", "u", "v", "key"), "edge_ord").drop("edge_ord")


def speeds(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.when(F.hour("ts") % 2 == 1, "observed").otherwise("predicted").alias("scenario"), F.col("user_id").alias("seg")).agg(F.avg("value").alias("speed"))


def more_speeds(spark, sf_dir):
    """The last reading of a segment, and its mean over all hours."""
    ev = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("seg"))
    last = ev.agg(F.max_by("value", F.struct("ts", "event_id")).alias("speed")).withColumn("scenario", F.lit("persistence"))
    return last.unionByName(ev.agg(F.avg("value").alias("speed")).withColumn("scenario", F.lit("historical")))


def all_weights(spark, sf_dir, more: bool = False):
    """static, predicted and observed; with `more` persistence and historical as well."""
    e = edges(spark, sf_dir)
    v = speeds(spark, sf_dir)
    w = G.scenario_weights(v.unionByName(more_speeds(spark, sf_dir)) if more else v, mapping(spark, sf_dir, e), e)
    s = G.static_weights(e).select(F.lit("static").alias("scenario"), "u", "v", "key", "length_m", F.col("static_speed").alias("speed"), F.col("static_weight").alias("weight"), F.lit(False).alias("is_dynamic"))
    return materialize(w.unionByName(s))


def nodes(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("node"), (20 + 0.01 * F.col("n_nationkey")).alias("lat"), (85 + 0.01 * (7 * F.col("n_nationkey") % 25)).alias("lon"))


def od(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    j = n.select(F.col("n_nationkey").alias("a")).crossJoin(n.select(F.col("n_nationkey").alias("b"))).where("a <> b")  # the origins and destinations asked for, a dimension of 25 rows
    return j.select((F.col("a") * 100 + F.col("b")).alias("od"), F.lpad(F.col("a").cast("string"), 2, "0").alias("source"), F.lpad(F.col("b").cast("string"), 2, "0").alias("target"))


E = """WITH RECURSIVE t AS (SELECT c_nationkey AS cu, s_nationkey AS cv, l_returnflag AS f, avg(l_quantity) * 100 AS length_m FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2, 3),
e AS MATERIALIZED (SELECT lpad(CAST(cu AS VARCHAR), 2, '0') AS u, lpad(CAST(cv AS VARCHAR), 2, '0') AS v, CAST(CASE f WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS INTEGER) AS key, length_m, CASE n_regionkey WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary' WHEN 3 THEN 'tertiary' ELSE 'residential' END AS highway, CASE n_regionkey WHEN 0 THEN 50.0 WHEN 1 THEN 40.0 WHEN 2 THEN 30.0 WHEN 3 THEN 25.0 ELSE 20.0 END AS static_speed, row_number() OVER (ORDER BY cu, cv, f) - 1 AS edge_ord FROM t JOIN nation ON cu = n_nationkey),
m AS (SELECT DISTINCT user_id AS seg, CASE user_id % 3 WHEN 0 THEN 'DYNAMIC' WHEN 1 THEN 'DYNAMIC_BIDIRECTIONAL' ELSE 'STATIC_FALLBACK' END AS policy, u, v, key FROM events JOIN e ON e.edge_ord = user_id % (SELECT count(*) FROM e)),
sp AS (SELECT CASE WHEN hour(ts) % 2 = 1 THEN 'observed' ELSE 'predicted' END AS scenario, user_id AS seg, avg(value) AS speed FROM events GROUP BY 1, 2),
ds AS (SELECT scenario, u, v, key, greatest(3.0, least(120.0, avg(speed))) AS speed FROM (SELECT scenario, m.u, m.v, m.key, speed FROM sp JOIN m USING (seg) WHERE policy <> 'STATIC_FALLBACK' UNION ALL SELECT scenario, e.u, e.v, e.key, speed FROM sp JOIN m USING (seg) JOIN e ON e.u = m.v AND e.v = m.u WHERE policy = 'DYNAMIC_BIDIRECTIONAL') GROUP BY 1, 2, 3, 4),
sc AS (SELECT unnest(['static', 'predicted', 'observed']) AS scenario),
w AS MATERIALIZED (SELECT sc.scenario, e.u, e.v, e.key, e.length_m, coalesce(ds.speed, static_speed) AS speed, greatest(e.length_m / (greatest(coalesce(ds.speed, static_speed), 3.0) / 3.6), 0.001) AS weight, ds.speed IS NOT NULL AS is_dynamic FROM e CROSS JOIN sc LEFT JOIN ds ON ds.scenario = sc.scenario AND ds.u = e.u AND ds.v = e.v AND ds.key = e.key)"""
NODES = ", nd AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS node, 20 + 0.01 * n_nationkey AS lat, 85 + 0.01 * (7 * n_nationkey % 25) AS lon FROM nation)"
OD = ", od AS (SELECT a.n_nationkey * 100 + b.n_nationkey AS od, lpad(CAST(a.n_nationkey AS VARCHAR), 2, '0') AS source, lpad(CAST(b.n_nationkey AS VARCHAR), 2, '0') AS target FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey)"
# Least costs by hops; paths and their observed costs go along with the least.
WALK = ", wk(scenario, src, node, hop, cost, obs, path) AS (SELECT scenario, node, node, 0, 0.0::DOUBLE, 0.0::DOUBLE, []::VARCHAR[] FROM sc, (SELECT DISTINCT u AS node FROM e) UNION ALL SELECT wk.scenario, src, w.v, hop + 1, min(cost + w.weight), arg_min(obs + o.weight, cost + w.weight), arg_min(list_append(path, w.u || '-' || w.v || '#' || w.key), cost + w.weight) FROM wk JOIN w ON w.scenario = wk.scenario AND w.u = wk.node JOIN w o ON o.scenario = 'observed' AND o.u = w.u AND o.v = w.v AND o.key = w.key WHERE hop < 24 GROUP BY 1, 2, 3, 4), best AS MATERIALIZED (SELECT scenario, src, node, min(cost) AS cost, arg_min(obs, cost) AS obs, arg_min(path, cost) AS path FROM wk GROUP BY 1, 2, 3)"


@query(E + " SELECT u, v, key, highway, round(static_speed, 2) AS static_speed, round(greatest(length_m / (static_speed / 3.6), 0.001), 4) AS static_weight FROM e")
def static_edge_weights(spark, sf_dir):
    return rounded(rounded(G.static_weights(edges(spark, sf_dir)).drop("edge_ord", "length_m"), "static_weight"), "static_speed", places=2)


@query(E + " SELECT scenario, u, v, key, round(speed, 4) AS speed, round(weight, 4) AS weight, is_dynamic FROM w")
def scenario_edge_weights(spark, sf_dir):
    return rounded(all_weights(spark, sf_dir).drop("length_m"), "speed", "weight")


@query(E + " SELECT policy, count(*) AS n, count(DISTINCT (u, v, key)) AS edges FROM m GROUP BY 1")
def mapping_status_counts(spark, sf_dir):
    return V.mapping_summary(mapping(spark, sf_dir, edges(spark, sf_dir)))


@query(E + WALK + " SELECT scenario, src AS source, node, round(cost, 4) AS cost FROM best")
def shortest_path_costs(spark, sf_dir):
    w = all_weights(spark, sf_dir)
    return rounded(R.relax(w, w.select("scenario", F.col("u").alias("source")).distinct()).select("scenario", "source", "node", "cost"), "cost")


def planned(spark, sf_dir, w, scenarios=("static", "predicted", "observed"), **options):
    s = spark.createDataFrame([(x,) for x in scenarios], "scenario string")
    return materialize(R.routes(od(spark, sf_dir).crossJoin(F.broadcast(s)), w, **options))


def path_text():
    """`edge_path` as text; a function, since expressions with lambdas need a session."""
    return F.array_join(F.transform("edge_path", lambda e: F.concat(e["u"], F.lit("-"), e["v"], F.lit("#"), e["key"].cast("string"))), ",")


@query(E + OD + WALK + " SELECT od.od, s.scenario, round(b.cost, 4) AS cost, b.cost IS NOT NULL AS is_reached, coalesce(array_to_string(b.path, ','), '') AS path, coalesce(len(b.path), 0) AS n_edges FROM od CROSS JOIN sc s LEFT JOIN best b ON b.scenario = s.scenario AND b.src = od.source AND b.node = od.target")
def dijkstra_routes(spark, sf_dir):
    r = planned(spark, sf_dir, all_weights(spark, sf_dir))
    return rounded(r.select("od", "scenario", "cost", "is_reached", path_text().alias("path"), F.size("edge_path").alias("n_edges")), "cost")


@query(E + OD + WALK + " SELECT od.od, round(b.cost, 4) AS cost, b.cost IS NOT NULL AS is_reached FROM od LEFT JOIN best b ON b.scenario = 'static' AND b.src = od.source AND b.node = od.target")
def astar_costs(spark, sf_dir):
    """Guided by the straight line at the speed of the edge that gains most of it, which no edge beats, so costs are least."""
    w, n = all_weights(spark, sf_dir), nodes(spark, sf_dir)
    r = planned(spark, sf_dir, w, ("static",), nodes=n, guided=True)
    return rounded(r.select("od", "cost", "is_reached"), "cost")


HOPS = ", h1 AS (SELECT scenario, u AS source, v AS node, 1 AS hops, weight AS cost, [u, v] AS path FROM w), h2 AS (SELECT h1.scenario, source, w.v AS node, 2 AS hops, cost + weight AS cost, list_append(path, w.v) AS path FROM h1 JOIN w ON w.scenario = h1.scenario AND w.u = h1.node WHERE NOT list_contains(path, w.v)), h3 AS (SELECT h2.scenario, source, w.v AS node, 3 AS hops, cost + weight AS cost, list_append(path, w.v) AS path FROM h2 JOIN w ON w.scenario = h2.scenario AND w.u = h2.node WHERE NOT list_contains(path, w.v))"


@query(E + HOPS + " SELECT scenario, source, node, hops, count(*) AS paths, round(min(cost), 4) AS least_cost FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY 1, 2, 3, 4")
def hop_bounded_paths(spark, sf_dir):
    p = R.hop_bounded(all_weights(spark, sf_dir), 3)
    return rounded(p.groupBy("scenario", "source", "node", "hops").agg(F.count("*").alias("paths"), F.min("cost").alias("least_cost")), "least_cost")


@query(E + OD + WALK + " SELECT od.od, b.scenario, round(b.obs, 4) AS observed_s FROM od JOIN best b ON b.src = od.source AND b.node = od.target")
def route_costing(spark, sf_dir):
    w = all_weights(spark, sf_dir)
    r = planned(spark, sf_dir, w).where("is_reached")
    return rounded(R.path_cost(r, w.where("scenario = 'observed'"), ["od", "scenario"], "observed_s").select("od", "scenario", "observed_s"), "observed_s")


def wide(spark, sf_dir, w=None):
    """Per OD: each scenario's route and what it takes under observed weights."""
    w = all_weights(spark, sf_dir) if w is None else w
    r = planned(spark, sf_dir, w).where("is_reached")
    r = R.path_cost(r, w.where("scenario = 'observed'"), ["od", "scenario"], "observed_s")
    return r.groupBy("od", "source", "target").pivot("scenario", ["static", "predicted", "observed"]).agg(F.first("observed_s").alias("s"), F.first("edge_path").alias("path"))


WIDE = ", x AS (SELECT od.od, a.obs AS static_s, b.obs AS predicted_s, c.obs AS observed_s, a.path AS static_path, b.path AS predicted_path, c.path AS observed_path FROM od JOIN best a ON a.scenario = 'static' AND a.src = od.source AND a.node = od.target JOIN best b ON b.scenario = 'predicted' AND b.src = od.source AND b.node = od.target JOIN best c ON c.scenario = 'observed' AND c.src = od.source AND c.node = od.target)"
JAC = "len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))"


@query(E + OD + WALK + WIDE + f" SELECT od, round({JAC.format(a='static_path', b='predicted_path')}, 4) AS static_predicted, round({JAC.format(a='predicted_path', b='observed_path')}, 4) AS predicted_observed FROM x")
def route_overlap_jaccard(spark, sf_dir):
    x = wide(spark, sf_dir)
    return rounded(x.select("od", R.jaccard("static_path", "predicted_path").alias("static_predicted"), R.jaccard("predicted_path", "observed_path").alias("predicted_observed")), "static_predicted", "predicted_observed")


@query(E + OD + WALK + WIDE + f" SELECT count(*) AS n, round(100.0 * count(*) FILTER ({JAC.format(a='static_path', b='predicted_path')} < 1) / count(*), 4) AS changed_pct, round(100.0 * count(*) FILTER (predicted_s < static_s - 1e-6) / count(*), 4) AS win_pct FROM x")
def changed_route_share(spark, sf_dir):
    x = wide(spark, sf_dir)
    return rounded(x.agg(F.count("*").alias("n"), (100.0 * F.count_if(R.jaccard("static_path", "predicted_path") < 1) / F.count("*")).alias("changed_pct"), (100.0 * F.count_if(F.col("predicted_s") < F.col("static_s") - 1e-6) / F.count("*")).alias("win_pct")), "changed_pct", "win_pct")


@query(E + OD + WALK + WIDE + " SELECT od, round(static_s, 4) AS static_s, round(predicted_s, 4) AS predicted_s, round(observed_s, 4) AS oracle_s, round(greatest(predicted_s - observed_s, 0), 4) AS regret_s, round(100 * (static_s - predicted_s) / static_s, 4) AS improvement_pct, round(100 * (predicted_s - observed_s) / observed_s, 4) AS gap_pct FROM x")
def od_scenario_evaluation(spark, sf_dir):
    x = wide(spark, sf_dir).select("od", "static_s", "predicted_s", F.col("observed_s").alias("oracle_s"))
    x = x.withColumns({"regret_s": F.greatest(F.col("predicted_s") - F.col("oracle_s"), F.lit(0.0)), "improvement_pct": 100 * F.try_divide(F.col("static_s") - F.col("predicted_s"), "static_s"), "gap_pct": 100 * F.try_divide(F.col("predicted_s") - F.col("oracle_s"), "oracle_s")})
    return rounded(x, "static_s", "predicted_s", "oracle_s", "regret_s", "improvement_pct", "gap_pct")


@query(E + OD + WALK + WIDE + ", l AS (SELECT od, static_s AS b, observed_s AS o, unnest(['static_s', 'predicted_s', 'observed_s']) AS strategy, unnest([static_s, predicted_s, observed_s]) AS t FROM x) SELECT strategy, count(*) AS n, round(avg(t), 4) AS mean_s, round(quantile_cont(t, 0.5), 4) AS median_s, round(stddev_samp(t), 4) AS std_s, round(avg(t) - 1.96 * stddev_samp(t) / sqrt(count(*)), 4) AS ci_low, round(avg(t) + 1.96 * stddev_samp(t) / sqrt(count(*)), 4) AS ci_high, round(avg(b - t), 4) AS mean_saving, round(100.0 * count(*) FILTER (b - t > 1e-6) / count(*), 4) AS win_pct, round(100.0 * count(*) FILTER (abs(b - t) <= 1e-6) / count(*), 4) AS tie_pct, round(100.0 * count(*) FILTER (b - t < -1e-6) / count(*), 4) AS loss_pct, round(avg(greatest(t - o, 0)), 4) AS mean_regret, round(100 * avg((t - o) / o), 4) AS gap_pct FROM l GROUP BY 1")
def strategy_summary(spark, sf_dir):
    x = wide(spark, sf_dir).select("od", F.col("static_s").alias("baseline_s"), F.col("observed_s").alias("oracle_s"), "static_s", "predicted_s", "observed_s")
    s = V.strategy_summary(V.long_form(x, ["od"], ["static_s", "predicted_s", "observed_s"]))
    return rounded(s, *(c for c in s.columns if c not in ("strategy", "n")))


STRATEGIES = ["static", "persistence", "historical", "predicted", "observed"]
E5 = E.replace("FROM events GROUP BY 1, 2),\nds AS", "FROM events GROUP BY 1, 2 UNION ALL SELECT 'persistence', user_id, arg_max(value, (ts, event_id)) FROM events GROUP BY 2 UNION ALL SELECT 'historical', user_id, avg(value) FROM events GROUP BY 2),\nds AS").replace("unnest(['static', 'predicted', 'observed'])", f"unnest({STRATEGIES})")


@query(E5 + OD + WALK + ", x AS (SELECT od.od, r.scenario AS strategy, r.obs AS t, s.obs AS b, o.obs AS o FROM od JOIN best r ON r.src = od.source AND r.node = od.target JOIN best s ON s.scenario = 'static' AND s.src = od.source AND s.node = od.target JOIN best o ON o.scenario = 'observed' AND o.src = od.source AND o.node = od.target) SELECT strategy, count(*) AS n, round(avg(t), 4) AS mean_s, round(quantile_cont(t, 0.5), 4) AS median_s, round(avg(b - t), 4) AS mean_saving, round(100.0 * count(*) FILTER (b - t > 1e-6) / count(*), 4) AS win_pct, round(100.0 * count(*) FILTER (b - t < -1e-6) / count(*), 4) AS loss_pct, round(avg(greatest(t - o, 0)), 4) AS mean_regret, round(100 * avg((t - o) / o), 4) AS gap_pct FROM x GROUP BY 1")
def five_strategies(spark, sf_dir):
    """Routes planned on five kinds of weights, each costed on what was observed."""
    w = all_weights(spark, sf_dir, more=True)
    r = R.path_cost(planned(spark, sf_dir, w, STRATEGIES).where("is_reached"), w.where("scenario = 'observed'"), ["od", "scenario"], "travel_s")
    side = lambda name, c: r.where(F.col("scenario") == name).select("od", F.col("travel_s").alias(c))
    long = r.select("od", F.col("scenario").alias("strategy"), "travel_s").join(side("static", "baseline_s"), "od").join(side("observed", "oracle_s"), "od")
    s = V.strategy_summary(long).select("strategy", "n", "mean_s", "median_s", "mean_saving", "win_pct", "loss_pct", "mean_regret", "gap_pct")
    return rounded(s, *(c for c in s.columns if c not in ("strategy", "n")))


SPEED = " SELECT od.od, round(3.6 * sum(w.length_m) / sum(w.weight), 4) AS static_kmh, round(3.6 * sum(w.length_m) / sum(o.weight), 4) AS observed_kmh, CAST(count(*) AS BIGINT) AS n_edges FROM od JOIN best b ON b.scenario = 'static' AND b.src = od.source AND b.node = od.target, unnest(b.path) AS p(leg) JOIN w ON w.scenario = 'static' AND w.u || '-' || w.v || '#' || w.key = leg JOIN w o ON o.scenario = 'observed' AND o.u = w.u AND o.v = w.v AND o.key = w.key GROUP BY 1"


@query(E + OD + WALK + SPEED)
def implied_route_speed(spark, sf_dir):
    w = all_weights(spark, sf_dir)
    r = planned(spark, sf_dir, w, ("static",)).where("is_reached")
    legs = r.select("od", F.explode("edge_path").alias("e")).select("od", "e.*")
    s, o = w.where("scenario = 'static'").select("u", "v", "key", "length_m", F.col("weight").alias("ws")), w.where("scenario = 'observed'").select("u", "v", "key", F.col("weight").alias("wo"))
    j = legs.join(s, ["u", "v", "key"]).join(o, ["u", "v", "key"]).groupBy("od").agg((3.6 * F.sum("length_m") / F.sum("ws")).alias("static_kmh"), (3.6 * F.sum("length_m") / F.sum("wo")).alias("observed_kmh"), F.count("*").alias("n_edges"))
    return rounded(j, "static_kmh", "observed_kmh")


# Journeys of two edges and more, reconsidered after a third of them.
REPLAY = ", j AS (SELECT od.od, od.target, b.path, CAST(greatest(1, least(floor(len(b.path) * 0.33), len(b.path) - 2)) AS INTEGER) AS k FROM od JOIN best b ON b.scenario = 'predicted' AND b.src = od.source AND b.node = od.target WHERE len(b.path) >= 2), jl AS (SELECT od, target, k, path, unnest(path) AS leg, generate_subscripts(path, 1) AS i FROM j), jp AS (SELECT od, any_value(target) AS target, any_value(k) AS k, coalesce(sum(p.weight) FILTER (i <= k), 0) AS prefix_s, coalesce(sum(o.weight) FILTER (i > k), 0) AS remaining_s, min(o.u) FILTER (i = k + 1) AS at FROM jl JOIN w p ON p.scenario = 'predicted' AND p.u || '-' || p.v || '#' || p.key = leg JOIN w o ON o.scenario = 'observed' AND o.u = p.u AND o.v = p.v AND o.key = p.key GROUP BY od), jr AS (SELECT jp.*, b.cost AS best_s, remaining_s - b.cost AS saving_s, 100 * (remaining_s - b.cost) / remaining_s AS saving_pct, prefix_s + remaining_s AS no_reroute_s FROM jp JOIN best b ON b.scenario = 'observed' AND b.src = jp.at AND b.node = jp.target)"


def replays(spark, sf_dir):
    w = all_weights(spark, sf_dir)
    p = planned(spark, sf_dir, w, ("predicted",)).where("is_reached").select("od", "source", "target", "edge_path")
    return R.replay(p, w.where("scenario = 'predicted'").drop("scenario"), w.where("scenario = 'observed'").drop("scenario"), 0.33, 10.0, 3.0)


@query(E + OD + WALK + REPLAY + " SELECT od, k, round(prefix_s, 4) AS prefix_s, round(remaining_s, 4) AS remaining_s, round(best_s, 4) AS best_s, round(saving_s, 4) AS saving_s, round(saving_pct, 4) AS saving_pct, saving_s >= 10 AND saving_pct >= 3 AS triggered, round(prefix_s + CASE WHEN saving_s >= 10 AND saving_pct >= 3 THEN best_s ELSE remaining_s END, 4) AS dynamic_s FROM jr")
def journey_replay(spark, sf_dir):
    r = replays(spark, sf_dir).select("od", "k", "prefix_s", "remaining_s", "best_s", "saving_s", "saving_pct", "triggered", "dynamic_s")
    return rounded(r, "prefix_s", "remaining_s", "best_s", "saving_s", "saving_pct", "dynamic_s")


@query(E + OD + WALK + REPLAY + " SELECT od, CASE WHEN saving_s >= 60 AND saving_pct >= 20 THEN 'triggered' WHEN saving_s < 60 AND saving_pct < 20 THEN 'both' WHEN saving_s < 60 THEN 'time_only' ELSE 'percent_only' END AS gate FROM jr")
def gate_failure_class(spark, sf_dir):
    return replays(spark, sf_dir).select("od", R.gate_failure(F.col("saving_s"), F.col("saving_pct"), 60.0, 20.0).alias("gate"))


SECONDS, PERCENTS = [0, 10, 30, 60], [0, 3, 5, 10, 20]


@query(E + OD + WALK + REPLAY + f", pg AS (SELECT CAST(a AS DOUBLE) AS min_s, CAST(b AS DOUBLE) AS min_pct, a || 's_' || b || 'pct' AS policy FROM unnest({SECONDS}) x(a), unnest({PERCENTS}) y(b)), pz AS (SELECT * REPLACE (CASE WHEN abs(saving_s) < 1e-9 THEN 0 ELSE saving_s END AS saving_s, CASE WHEN abs(saving_s) < 1e-9 THEN 0 ELSE saving_pct END AS saving_pct) FROM jr), pj AS (SELECT *, saving_s >= min_s AND saving_pct >= min_pct AS hit, CASE WHEN saving_s >= min_s AND saving_pct >= min_pct THEN saving_s ELSE 0 END AS got FROM pz, pg) SELECT policy, min_s, min_pct, count(*) AS n, count(*) FILTER (hit) AS reroutes, round(100.0 * count(*) FILTER (hit) / count(*), 4) AS reroute_pct, round(100.0 * count(*) FILTER (hit AND saving_s > 0) / count(*), 4) AS beneficial_pct, round(100.0 * count(*) FILTER (hit AND saving_s < 0) / count(*), 4) AS detrimental_pct, round(avg(got), 4) AS mean_saving, round(quantile_cont(got, 0.5), 4) AS median_saving, round(avg(saving_s) FILTER (hit), 4) AS mean_saving_hit, round(avg(no_reroute_s - got), 4) AS mean_journey_s FROM pj GROUP BY 1, 2, 3")
def threshold_grid(spark, sf_dir):
    s = V.policy_summary(replays(spark, sf_dir).withColumns({c: F.when(F.abs("saving_s") < 1e-9, 0.0).otherwise(F.col(c)) for c in ("saving_s", "saving_pct")}), V.grid(spark, SECONDS, PERCENTS))
    return rounded(s, "reroute_pct", "beneficial_pct", "detrimental_pct", "mean_saving", "median_saving", "mean_saving_hit", "mean_journey_s")


OBS = "(SELECT * FROM w WHERE scenario = 'observed')"


@query(E + OD + f", c AS (SELECT od.od AS id, o.v, o.key, o.weight, count(*) OVER (PARTITION BY od.od) AS n_out, row_number() OVER (PARTITION BY od.od ORDER BY (o.v = od.source), o.weight, o.v, o.key) AS rank FROM od JOIN {OBS} o ON o.u = od.source) SELECT id, v, key, round(weight, 4) AS weight, n_out, rank FROM c WHERE rank <= 2")
def candidate_pairs(spark, sf_dir):
    w = all_weights(spark, sf_dir).where("scenario = 'observed'")
    s = od(spark, sf_dir).select(F.col("od").alias("id"), F.col("source").alias("at"), F.lit(None).cast("string").alias("prev"), F.array("source").alias("visited"))
    return rounded(S.candidates(s, w).select("id", "v", "key", "weight", "n_out", "rank"), "weight")


def _greedy_sql(extra: str) -> str:
    score = f"o.weight{extra} + CASE WHEN list_contains(g.path, o.v) THEN 1000.0 ELSE 0 END + CASE WHEN o.v = g.prev THEN 1e6 ELSE 0 END"
    pick = f"arg_min({{'v': o.v, 'w': o.weight}}, {score})"
    join = f"JOIN {OBS} o ON o.u = g.cur" + (" JOIN nd a ON a.node = o.v JOIN nd b ON b.node = g.target" if extra else "")
    return f", g(id, target, cur, prev, path, cost, hop, most) AS (SELECT od.od, od.target, od.source, '', [od.source], 0.0::DOUBLE, 0, greatest(50, coalesce(3 * (len(b.path) + 1), 0)) FROM od LEFT JOIN best b ON b.scenario = 'observed' AND b.src = od.source AND b.node = od.target UNION ALL SELECT id, target, p.v, cur, list_append(path, p.v), cost + p.w, hop + 1, most FROM (SELECT g.id, g.target, g.cur, g.path, g.cost, g.hop, g.most, {pick} AS p FROM g {join} WHERE g.hop < g.most AND g.cur <> g.target GROUP BY 1, 2, 3, 4, 5, 6, 7)) SELECT id, arg_max(array_to_string(path, ','), hop) AS path, round(max(cost), 4) AS cost, CAST(max(hop) AS INTEGER) AS hops, arg_max(cur, hop) = any_value(target) AS arrived FROM g GROUP BY id"


AHEAD = " + 2 * 6371000.0 * atan2(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)), sqrt(1 - (pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) / (25.0 / 3.6)"


def _walk(spark, sf_dir, n):
    w = all_weights(spark, sf_dir)
    best = planned(spark, sf_dir, w, ("observed",)).select(F.col("od").alias("id"), "source", "target", F.greatest(F.lit(50), 3 * F.size("node_path")).alias("max_hops"))
    g = S.greedy_walk(best, w.where("scenario = 'observed'"), n)
    return rounded(g.select("id", F.array_join("path", ",").alias("path"), "cost", "hops", "arrived"), "cost")


@query(E + OD + WALK + _greedy_sql(""))
def greedy_walk(spark, sf_dir):
    return _walk(spark, sf_dir, None)


@query(E + NODES + OD + WALK + _greedy_sql(AHEAD))
def dest_aware_walk(spark, sf_dir):
    return _walk(spark, sf_dir, nodes(spark, sf_dir))


LOOK = f""", c AS (SELECT od.od AS id, od.source, od.target, o.v, o.key, o.weight FROM od JOIN {OBS} o ON o.u = od.source),
x AS (SELECT c.id, c.v, c.key, c.target, n.v AS nv, n.weight AS nw, row_number() OVER (PARTITION BY c.id, c.v, c.key ORDER BY n.weight, n.v, n.key) AS k FROM c JOIN {OBS} n ON n.u = c.v AND n.v <> c.source AND n.v <> c.v),
y AS (SELECT x.id, x.v, x.key, min(nw + CASE WHEN nv = x.target THEN 0 ELSE {AHEAD[3:]} END) AS m FROM x JOIN nd a ON a.node = x.nv JOIN nd b ON b.node = x.target WHERE k <= 4 GROUP BY 1, 2, 3)
SELECT c.id, c.v, c.key, round(c.weight + CASE WHEN c.v = c.target THEN 0 WHEN c.v NOT IN (SELECT u FROM {OBS}) THEN 1e6 ELSE coalesce(y.m, 1e5) END, 4) AS look_s FROM c LEFT JOIN y ON y.id = c.id AND y.v = c.v AND y.key = c.key"""


@query(E + NODES + OD + LOOK)
def lookahead_scores(spark, sf_dir):
    w = all_weights(spark, sf_dir).where("scenario = 'observed'")
    e = od(spark, sf_dir).select(F.col("od").alias("id"), F.col("source").alias("at"), "target").join(w.select(F.col("u").alias("at"), "v", "key", "weight"), "at")
    return rounded(S.lookahead_two(e, w, nodes(spark, sf_dir)).select("id", "v", "key", "look_s"), "look_s")


@query(E + OD + WALK + ", tl AS (SELECT od.od, unnest(b.path) AS leg, generate_subscripts(b.path, 1) - 1 AS step, len(b.path) AS n FROM od JOIN best b ON b.scenario = 'predicted' AND b.src = od.source AND b.node = od.target) SELECT od, CAST(step AS INTEGER) AS step, w.v AS node, round(sum(w.weight) OVER (PARTITION BY od ORDER BY step), 4) AS elapsed_s, round(sum(w.length_m) OVER (PARTITION BY od ORDER BY step), 4) AS distance_m, round(100.0 * (step + 1) / n, 4) AS progress_pct FROM tl JOIN w ON w.scenario = 'predicted' AND w.u || '-' || w.v || '#' || w.key = leg")
def journey_timeline(spark, sf_dir):
    w = all_weights(spark, sf_dir)
    r = planned(spark, sf_dir, w, ("predicted",)).where("is_reached")
    return rounded(S.timeline(r, w.where("scenario = 'predicted'"), ["od"]), "elapsed_s", "distance_m", "progress_pct")


@query(E + OD + WALK + WIDE + f", b AS (SELECT od, unnest(list_filter(static_path, lambda p: NOT list_contains(predicted_path, p))) AS leg FROM x), c AS (SELECT b.od, o.u, o.v, o.key, o.weight, o.speed, p.speed AS predicted, row_number() OVER (PARTITION BY b.od ORDER BY o.weight DESC, o.u, o.v, o.key) AS r FROM b JOIN {OBS} o ON o.u || '-' || o.v || '#' || o.key = leg JOIN w p ON p.scenario = 'predicted' AND p.u = o.u AND p.v = o.v AND p.key = o.key) SELECT od, u, v, key, round(weight, 4) AS weight, round(speed, 4) AS observed_kmh, round(predicted, 4) AS predicted_kmh, round(greatest(0, predicted - speed), 4) AS drop_kmh, round(100 * greatest(0, predicted - speed) / predicted, 4) AS drop_pct FROM c WHERE r = 1")
def bottleneck_edges(spark, sf_dir):
    """The slowest observed edge of those that the predicted route goes around."""
    w = all_weights(spark, sf_dir)
    legs = wide(spark, sf_dir, w).select("od", F.explode(F.array_except("static_path", "predicted_path")).alias("e")).select("od", "e.*").join(w.where("scenario = 'observed'").select("u", "v", "key", "weight", F.col("speed").alias("observed_kmh")), ["u", "v", "key"])
    legs = legs.join(w.where("scenario = 'predicted'").select("u", "v", "key", F.col("speed").alias("predicted_kmh")), ["u", "v", "key"])
    drop = F.greatest(F.lit(0.0), F.col("predicted_kmh") - F.col("observed_kmh"))
    best = legs.withColumn("r", F.row_number().over(Window.partitionBy("od").orderBy(F.desc("weight"), "u", "v", "key"))).where("r = 1")
    names = ["observed_kmh", "predicted_kmh", "drop_kmh", "drop_pct"]
    best = best.withColumns({"drop_kmh": drop, "drop_pct": 100 * F.try_divide(drop, "predicted_kmh")})
    return rounded(best.select("od", "u", "v", "key", "weight", *names), "weight", *names)


@query(E + " SELECT CASE WHEN speed >= 35 THEN 'free' WHEN speed >= 20 THEN 'moderate' ELSE 'congested' END AS speed_class, scenario, count(*) AS n, round(avg(speed), 4) AS mean_speed FROM w GROUP BY 1, 2")
def speed_classes(spark, sf_dir):
    return rounded(all_weights(spark, sf_dir).groupBy(K.speed_class(F.col("speed")).alias("speed_class"), "scenario").agg(F.count("*").alias("n"), F.avg("speed").alias("mean_speed")), "mean_speed")


@query(E + " SELECT u, v, key, round(greatest(length_m / (static_speed / 3.6), 0.001) * CASE WHEN edge_ord < 30 THEN 2.0 ELSE 1.0 END, 4) AS weight FROM e")
def injected_congestion(spark, sf_dir):
    w = G.static_weights(edges(spark, sf_dir)).withColumnRenamed("static_weight", "weight")
    return rounded(G.congest(w, 30, 2.0).select("u", "v", "key", "weight"), "weight")
