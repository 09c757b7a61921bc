"""Routes planned on the growing network, judged again as its weights change."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from ..operators import routing as R
from ..operators import versions as V
from .network_queries import NET, network, requests
from .registry import query, rounded, table

#: Seconds at which weights change, and for which orders by which factor of the first weight.
TIMES = {100.0: ("1-URGENT", 4.0), 200.0: ("2-HIGH", 0.25), 300.0: ("1-URGENT", 1.0)}
LEAST_S, LEAST_PCT, HOPS = 10.0, 3.0, 24


def changes(spark, sf_dir):
    """u, v, key, valid_from, weight."""
    w = network(spark, sf_dir).drop("scenario")
    kind = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int").alias("key"), F.col("o_orderpriority").alias("priority"))
    out = w.withColumn("valid_from", F.lit(-1.0))
    for t, (priority, factor) in TIMES.items():
        some = w.join(kind.where(F.col("priority") == priority), "key")
        out = out.unionByName(some.select("u", "v", "key", (F.col("weight") * factor).alias("weight"), F.lit(t).alias("valid_from")))
    return out


def plans(spark, sf_dir):
    found = R.routes(requests(spark, sf_dir).where("source <> target"), network(spark, sf_dir), counted=False).where("is_reached")
    return found.select("id", "source", "target", (20.0 * (F.col("id") % 7)).alias("depart_s"), "edge_path")


def weight_sql(t: float) -> str:
    """The weight in force at t."""
    first = "o_totalprice / 1000"
    for at, (priority, factor) in TIMES.items():
        if at <= t:
            first = f"CASE WHEN o_orderpriority = '{priority}' THEN o_totalprice / 1000 * {factor} ELSE {first} END"
    return first


@cache
def versions_sql() -> str:
    """Trees a version and target, plans (timed by what is in force at departure), and the rounds one after another."""
    out = NET + """,
q AS (SELECT id, CAST(source AS VARCHAR) AS source, CAST(target AS VARCHAR) AS target, CAST(20 * (id % 7) AS DOUBLE) AS depart FROM r WHERE source <> target),"""
    steps = []
    for n, t in enumerate((0.0, *TIMES)):
        steps.append(f"""
ed{n} AS MATERIALIZED (SELECT CAST(o_custkey AS VARCHAR) AS u, CAST((o_custkey * 31 + o_orderkey * 17) % n AS VARCHAR) AS v, CAST(o_orderkey AS INTEGER) AS key, {weight_sql(t)} AS w FROM orders, c),
tk{n}(target, node, hop, cost) AS (SELECT DISTINCT target, target, 0, 0.0::DOUBLE FROM q UNION ALL SELECT k.target, e.u, hop + 1, min(cost + w) FROM tk{n} k JOIN ed{n} e ON e.v = k.node WHERE hop < {HOPS} GROUP BY 1, 2, 3),
tr{n} AS MATERIALIZED (SELECT target, node, min(cost) AS cost FROM tk{n} GROUP BY 1, 2),
nx{n} AS MATERIALIZED (SELECT k.target, e.u AS node, arg_min({{'v': e.v, 'key': e.key, 'w': e.w}}, e.w + k.cost) AS e FROM ed{n} e JOIN tr{n} k ON k.node = e.v WHERE e.u <> k.target GROUP BY 1, 2)""")
    out += ",".join(steps)
    out += """,
p0(id, target, i, u, v, key, w, entry) AS (SELECT id, q.target, 0, q.source, e.v, e.key, e.w, depart FROM q JOIN nx0 ON nx0.target = q.target AND nx0.node = q.source UNION ALL SELECT id, p0.target, i + 1, p0.v, e.v, e.key, e.w, entry + p0.w FROM p0 JOIN nx0 ON nx0.target = p0.target AND nx0.node = p0.v),
g0 AS MATERIALIZED (SELECT p.id, p.target, i, p.u, p.v, p.key, w0 AS w, depart + coalesce(sum(w0) OVER (PARTITION BY p.id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS entry FROM (SELECT p0.*, depart, CASE WHEN depart >= 100 THEN b.w ELSE a.w END AS w0 FROM p0 JOIN q USING (id) JOIN ed0 a ON a.u = p0.u AND a.v = p0.v AND a.key = p0.key JOIN ed1 b ON b.u = p0.u AND b.v = p0.v AND b.key = p0.key) p)"""
    for n, t in enumerate(TIMES, 1):
        b = n - 1
        out += f""",
a{n} AS (SELECT id, any_value(g.target) AS target, min(i) FILTER (entry >= {t}) AS d FROM g{b} g JOIN q USING (id) GROUP BY id HAVING any_value(depart) < {t} AND max(entry + w) > {t}),
m{n} AS MATERIALIZED (SELECT a.id, a.target, a.d, g.i, g.u, g.v, g.key, e.w, min(entry) OVER (PARTITION BY a.id) + coalesce(sum(e.w) OVER (PARTITION BY a.id ORDER BY g.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS entry FROM a{n} a JOIN g{b} g ON g.id = a.id AND g.i >= a.d JOIN ed{n} e ON e.u = g.u AND e.v = g.v AND e.key = g.key),
d{n} AS MATERIALIZED (SELECT a.id, CAST({t} AS DOUBLE) AS t, a.target, x.at_node, a.d, start_s, x.remaining_s, k.cost AS best_s, x.remaining_s - k.cost AS saving_s, 100 * (x.remaining_s - k.cost) / x.remaining_s AS saving_pct, coalesce(x.remaining_s - k.cost >= {LEAST_S} AND 100 * (x.remaining_s - k.cost) / x.remaining_s >= {LEAST_PCT}, false) AS triggered FROM a{n} a LEFT JOIN (SELECT id, arg_min(u, i) AS at_node, sum(w) AS remaining_s, min(entry) AS start_s FROM m{n} GROUP BY 1) x USING (id) LEFT JOIN tr{n} k ON k.target = a.target AND k.node = x.at_node),
p{n}(id, target, i, u, v, key, w, entry) AS (SELECT d.id, d.target, d, at_node, e.v, e.key, e.w, start_s FROM d{n} d JOIN nx{n} x ON x.target = d.target AND x.node = at_node WHERE triggered UNION ALL SELECT p.id, p.target, i + 1, p.v, e.v, e.key, e.w, entry + p.w FROM p{n} p JOIN nx{n} x ON x.target = p.target AND x.node = p.v),
g{n} AS MATERIALIZED (SELECT g.* FROM g{b} g LEFT JOIN a{n} a USING (id) WHERE a.d IS NULL OR i < a.d UNION ALL SELECT m.id, m.target, i, u, v, key, w, entry FROM m{n} m JOIN d{n} d USING (id) WHERE NOT triggered UNION ALL SELECT * FROM p{n})"""
    return out


LAST = len(TIMES)
LOG = " UNION ALL ".join(f"SELECT * FROM d{n}" for n in range(1, LAST + 1))


@query(versions_sql() + f" SELECT id, t, at_node AS node, CAST(d AS INTEGER) AS leg, round(remaining_s, 4) AS remaining_s, round(best_s, 4) AS best_s, round(saving_s, 4) AS saving_s, round(saving_pct, 4) AS saving_pct, triggered FROM ({LOG})")
def reroute_decisions(spark, sf_dir):
    """Every version that every journey met, and whether the gate opened."""
    _, log = V.rejudge(plans(spark, sf_dir), changes(spark, sf_dir), LEAST_S, LEAST_PCT)
    names = ["remaining_s", "best_s", "saving_s", "saving_pct"]
    return rounded(log.select("id", "t", F.col("at").alias("node"), "leg", *names, "triggered"), *names)


@query(versions_sql() + f", lg AS (SELECT id, count(*) AS n, count(*) FILTER (triggered) AS k FROM ({LOG}) GROUP BY 1) SELECT q.id, depart AS depart_s, round(max(entry + w) - depart, 4) AS travel_s, count(*) AS n_edges, coalesce(any_value(lg.n), 0) AS n_versions, coalesce(any_value(k), 0) AS n_rerouted FROM q JOIN g{LAST} USING (id) LEFT JOIN lg USING (id) GROUP BY q.id, depart")
def rerouted_plans(spark, sf_dir):
    """The journeys as they came about."""
    done, _ = V.rejudge(plans(spark, sf_dir), changes(spark, sf_dir), LEAST_S, LEAST_PCT)
    return rounded(done.select("id", "depart_s", "travel_s", F.size("edge_path").cast("long").alias("n_edges"), "n_versions", "n_rerouted"), "travel_s")
