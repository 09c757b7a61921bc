"""Further routing and matching queries: samples, feasibility, comparisons, catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kinematics as K
from ..functions import sql as SQL
from ..operators import audit as A
from ..operators import matching as M
from ..operators import ranks
from ..operators import routing as R
from ..scratch import materialize
from . import road_queries as Q
from .network_queries import network
from .registry import query, rounded, table

DIST = "2 * 6371000.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))"


@query("WITH nd AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS node, 20 + 0.01 * n_nationkey AS lat, 85 + 0.01 * (7 * n_nationkey % 25) AS lon FROM nation), " f"p AS (SELECT a.node AS source, b.node AS target, {DIST} AS metres FROM nd a, nd b WHERE a.node <> b.node) SELECT source, target, round(metres, 3) AS metres FROM p WHERE metres BETWEEN 2000 AND 14000 ORDER BY md5(source || '>' || target || '#42') LIMIT 30")
def od_sample(spark, sf_dir):
    """A repeatable sample of pairs 2 to 14 km apart, by the order of a hash."""
    n = Q.nodes(spark, sf_dir)
    a, b = (n.select(F.col("node").alias(c), F.col("lat").alias(f"y{c}"), F.col("lon").alias(f"x{c}")) for c in ("source", "target"))
    p = a.crossJoin(b).where("source <> target").withColumn("metres", K.haversine(*(F.col(c) for c in ("ysource", "xsource", "ytarget", "xtarget")))).where(F.col("metres").between(2000, 14000))  # nodes of one small dimension
    s = p.orderBy(F.md5(F.concat("source", F.lit(">"), "target", F.lit("#42")).cast("binary"))).limit(30)
    return rounded(s.select("source", "target", "metres"), "metres", places=3)


@query(Q.E + Q.OD + Q.WALK + ", r AS (SELECT od.od, b.path FROM od LEFT JOIN best b ON b.scenario = 'static' AND b.src = od.source AND b.node = od.target), l AS (SELECT od, unnest(path) AS leg FROM r), c AS (SELECT od, sum(length_m) AS metres, 100.0 * count(*) FILTER (is_dynamic) / count(*) AS coverage FROM l JOIN w ON w.scenario = 'observed' AND w.u || '-' || w.v || '#' || w.key = leg GROUP BY 1) SELECT round(100.0 * count(c.od) / count(*), 4) AS success_pct, round(min(metres), 3) AS min_m, round(quantile_cont(metres, 0.5), 3) AS median_m, round(max(metres), 3) AS max_m, round(avg(coverage), 4) AS mean_coverage, round(quantile_cont(coverage, 0.25), 4) AS q25, round(quantile_cont(coverage, 0.75), 4) AS q75, " + ", ".join(f"round(100.0 * count(*) FILTER (coverage > {k}) / count(c.od), 4) AS above_{k}" for k in (25, 50, 75, 90)) + " FROM r LEFT JOIN c ON c.od = r.od")
def od_feasibility(spark, sf_dir):
    w = Q.all_weights(spark, sf_dir)
    r = Q.planned(spark, sf_dir, w, ("static",))
    legs = r.select("od", F.explode("edge_path").alias("e")).select("od", "e.*").join(w.where("scenario = 'observed'").select("u", "v", "key", "length_m", "is_dynamic"), ["u", "v", "key"])
    c = legs.groupBy("od").agg(F.sum("length_m").alias("metres"), (100.0 * F.count_if("is_dynamic") / F.count("*")).alias("coverage"))
    j = r.select("od").join(c, "od", "left")
    one = j.agg((100.0 * F.count("metres") / F.count("*")).alias("success_pct"), F.min("metres").alias("min_m"), F.percentile("metres", 0.5).alias("median_m"), F.max("metres").alias("max_m"), F.avg("coverage").alias("mean_coverage"), F.percentile("coverage", 0.25).alias("q25"), F.percentile("coverage", 0.75).alias("q75"), *((100.0 * F.count_if(F.col("coverage") > k) / F.count("metres")).alias(f"above_{k}") for k in (25, 50, 75, 90)))
    m = ["min_m", "median_m", "max_m"]
    return rounded(rounded(one, *m, places=3), *(c for c in one.columns if c not in m))


@query(Q.E + Q.OD + Q.WALK + ", l AS (SELECT od.od, unnest(b.path) AS leg FROM od JOIN best b ON b.scenario = 'predicted' AND b.src = od.source AND b.node = od.target) SELECT od, round(avg(p.speed), 4) AS predicted_kmh, round(avg(o.speed), 4) AS observed_kmh, round(100 * (avg(p.speed) - avg(o.speed)) / avg(o.speed), 4) AS error_pct, round(100 * (avg(p.speed) - avg(o.speed)) / avg(p.speed), 4) AS drop_pct FROM l JOIN w p ON p.scenario = 'predicted' AND p.u || '-' || p.v || '#' || p.key = leg JOIN w o ON o.scenario = 'observed' AND o.u = p.u AND o.v = p.v AND o.key = p.key GROUP BY 1")
def corridor_speeds(spark, sf_dir):
    w = Q.all_weights(spark, sf_dir)
    legs = Q.planned(spark, sf_dir, w, ("predicted",)).where("is_reached").select("od", F.explode("edge_path").alias("e")).select("od", "e.*")
    p, o = (w.where(f"scenario = '{s}'").select("u", "v", "key", F.col("speed").alias(s)) for s in ("predicted", "observed"))
    c = legs.join(p, ["u", "v", "key"]).join(o, ["u", "v", "key"]).groupBy("od").agg(F.avg("predicted").alias("predicted_kmh"), F.avg("observed").alias("observed_kmh"))
    gap = F.col("predicted_kmh") - F.col("observed_kmh")
    c = c.withColumn("error_pct", 100 * F.try_divide(gap, "observed_kmh")).withColumn("drop_pct", 100 * F.try_divide(gap, "predicted_kmh"))
    return rounded(c, "predicted_kmh", "observed_kmh", "error_pct", "drop_pct")


@query(Q.E + Q.OD + Q.WALK + Q.REPLAY + ", g AS (SELECT *, saving_s >= 10 AND saving_pct >= 3 AS hit FROM jr) SELECT count(*) AS n, count(*) FILTER (hit) AS rerouted, count(*) FILTER (hit AND saving_s > 0) AS beneficial, round(avg(CASE WHEN hit THEN saving_s ELSE 0 END), 4) AS mean_saving, round(avg(saving_s) FILTER (hit), 4) AS mean_saving_hit, round(avg(no_reroute_s), 4) AS mean_no_reroute, round(avg(no_reroute_s - CASE WHEN hit THEN saving_s ELSE 0 END), 4) AS mean_dynamic FROM g")
def replay_benchmark(spark, sf_dir):
    r, hit = Q.replays(spark, sf_dir), F.col("triggered")
    one = r.agg(F.count("*").alias("n"), F.count_if(hit).alias("rerouted"), F.count_if(hit & (F.col("saving_s") > 0)).alias("beneficial"), F.avg(F.when(hit, F.col("saving_s")).otherwise(0.0)).alias("mean_saving"), F.avg(F.when(hit, F.col("saving_s"))).alias("mean_saving_hit"), F.avg("no_reroute_s").alias("mean_no_reroute"), F.avg("dynamic_s").alias("mean_dynamic"))
    return rounded(one, "mean_saving", "mean_saving_hit", "mean_no_reroute", "mean_dynamic")


@query(Q.E + Q.OD + Q.WALK + Q.REPLAY + " SELECT od, CASE WHEN saving_s >= 10 AND saving_pct >= 3 THEN 'reroute' ELSE 'keep' END AS kind, CASE WHEN od % 2 = 0 THEN 'peak' ELSE 'off_peak' END AS period FROM jr UNION ALL SELECT od.od, 'unreachable', CASE WHEN od.od % 2 = 0 THEN 'peak' ELSE 'off_peak' END FROM od LEFT JOIN best b ON b.scenario = 'predicted' AND b.src = od.source AND b.node = od.target WHERE b.cost IS NULL")
def scenario_catalogue(spark, sf_dir):
    """What a user may pick: replays by outcome, and pairs without a route."""
    period = F.when(F.col("od") % 2 == 0, "peak").otherwise("off_peak").alias("period")
    played = Q.replays(spark, sf_dir).select("od", F.when(F.col("triggered"), "reroute").otherwise("keep").alias("kind"), period)
    w = Q.all_weights(spark, sf_dir)
    return played.unionByName(Q.planned(spark, sf_dir, w, ("predicted",)).where("not is_reached").select("od", F.lit("unreachable").alias("kind"), period))


@query("SELECT way, count(*) AS pieces, round(sum(m), 3) AS length_m FROM (SELECT DISTINCT l_partkey % 50 AS way, l_suppkey AS g, l_suppkey * 1.5 AS m FROM lineitem) GROUP BY 1")
def way_dissolve(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("way"), F.col("l_suppkey").alias("geom_key"), (F.col("l_suppkey") * 1.5).alias("length_m"))
    return rounded(M.dissolve(p), "length_m", places=3)


@query("WITH m AS (SELECT DISTINCT user_id AS seg, user_id % 20 AS edge FROM events), h AS (SELECT user_id AS seg, date_trunc('day', ts) AS hr, avg(value) AS speed FROM events GROUP BY 1, 2), p AS (SELECT a.seg AS a, b.seg AS b FROM m a JOIN m b ON a.edge = b.edge AND a.seg < b.seg), j AS (SELECT p.a, p.b, count(*) AS hours, max(abs(x.speed - y.speed)) AS d, CASE WHEN stddev_pop(x.speed) > 1e-9 AND stddev_pop(y.speed) > 1e-9 THEN corr(x.speed, y.speed) END AS r FROM p JOIN h x ON x.seg = p.a JOIN h y ON y.seg = p.b AND y.hr = x.hr GROUP BY 1, 2) SELECT p.a, p.b, coalesce(hours, 0) AS hours, round(r, 5) AS r, CASE WHEN coalesce(hours, 0) < 3 THEN 'D' WHEN d <= 1e-9 THEN 'A' WHEN r >= 0.9 THEN 'B' ELSE 'C' END AS kind FROM p LEFT JOIN j USING (a, b)")
def duplicate_mapping_classes(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    mapping = ev.select(F.col("user_id").alias("seg"), (F.col("user_id") % 20).alias("edge")).distinct()
    series = ev.groupBy(F.col("user_id").alias("seg"), F.date_trunc("day", "ts").alias("hr")).agg(F.avg("value").alias("speed"))
    return rounded(M.duplicate_classes(mapping, series, ["edge"]), "r", places=5)


@query("WITH x AS (SELECT s_suppkey, c_custkey, abs(s_acctbal - c_acctbal) / 20 / 50 + CASE WHEN s_suppkey % 5 = c_custkey % 5 THEN 0 ELSE 1 END + 0.25 * abs(ln(greatest(abs(s_acctbal), 1) / greatest(abs(c_acctbal), 1))) AS score FROM supplier JOIN customer ON s_nationkey = c_nationkey), r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY round(score, 9), c_custkey) AS k FROM x) SELECT s_suppkey, c_custkey, round(score, 5) AS score FROM r WHERE k = 1")
def first_match_scores(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")

    def score_of(i, x, j, y):
        import numpy as np

        return -np.abs(x - y) / 1000 - (i % 5 != j % 5) - 0.25 * np.abs(np.log(np.maximum(np.abs(x), 1) / np.maximum(np.abs(y), 1)))

    some = M.contenders(s.withColumnsRenamed({"s_nationkey": "g", "s_acctbal": "x"}), c.withColumnsRenamed({"c_nationkey": "g", "c_acctbal": "x"}), "g", "s_suppkey", "c_custkey", "x", score_of, 1)
    j = some.join(s, "s_suppkey").join(c, "c_custkey").where("s_nationkey = c_nationkey")
    score = M.first_score(F.abs(F.col("s_acctbal") - F.col("c_acctbal")) / 20, F.col("s_suppkey") % 5 == F.col("c_custkey") % 5, F.abs("s_acctbal"), F.abs("c_acctbal"))
    j = rounded(j.withColumn("score", score).withColumn("_s", F.col("score")), "_s", places=9)
    return rounded(M.top(j, "s_suppkey", ["_s", "c_custkey"], 1).select("s_suppkey", "c_custkey", "score"), "score", places=5)


@query("SELECT CASE WHEN value >= 35 THEN 'free' WHEN value >= 20 THEN 'moderate' ELSE 'congested' END AS speed_class, count(*) AS n, round(sum(greatest(100.0 / (greatest(value, 3.0) / 3.6), 0.001)), 3) AS seconds FROM events GROUP BY 1")
def sql_functions(spark, sf_dir):
    """The functions under their SQL names."""
    SQL.register(spark)
    e = table(spark, sf_dir, "events").selectExpr("speed_class(value) AS speed_class", "travel_time_s(100.0D, value) AS s")
    return rounded(e.groupBy("speed_class").agg(F.count("*").alias("n"), F.sum("s").alias("seconds")), "seconds", places=3)


@query("SELECT event_type, count(*) AS n, round(min((epoch(ts) - epoch(date_trunc('hour', ts))) / 60), 4) AS min_offset, round(quantile_cont((epoch(ts) - epoch(date_trunc('hour', ts))) / 60, 0.5), 4) AS median_offset, round(max((epoch(ts) - epoch(date_trunc('hour', ts))) / 60), 4) AS max_offset, count(*) FILTER (ts = date_trunc('hour', ts)) AS strictly_hourly FROM events GROUP BY 1")
def bucket_offsets(spark, sf_dir):
    """Minutes between an observation and the start of its hour."""
    e = table(spark, sf_dir, "events").withColumn("m", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.date_trunc("hour", "ts").cast("timestamp"))) / 6e7)
    return rounded(e.groupBy("event_type").agg(F.count("*").alias("n"), F.min("m").alias("min_offset"), F.percentile("m", 0.5).alias("median_offset"), F.max("m").alias("max_offset"), F.count_if(F.col("m") == 0).alias("strictly_hourly")), "min_offset", "median_offset", "max_offset")


@query("WITH h AS (SELECT user_id AS seg, date_trunc('hour', ts) AS hr, avg(value) AS speed FROM events GROUP BY 1, 2) SELECT count(*) AS n, count(*) FILTER (speed > 120) AS above_120, count(*) FILTER (speed > 160) AS above_160, count(*) FILTER (speed > 0) AS positive FROM h")
def range_checks(spark, sf_dir):
    h = A.hourly(table(spark, sf_dir, "events"))
    return h.agg(F.count("*").alias("n"), *(F.count_if(F.col("speed") > k).alias(f"above_{k}") for k in (120, 160)), F.count_if(F.col("speed") > 0).alias("positive"))


# Tables of SQL over a network and its routes.

SQL_NET = """WITH c AS (SELECT count(*) AS n FROM customer),
e AS MATERIALIZED (SELECT CAST(o_custkey AS VARCHAR) AS u, CAST((o_custkey * 31 + o_orderkey * 17) % n AS VARCHAR) AS v, CAST(o_orderkey AS INTEGER) AS key, o_totalprice / 1000 AS weight FROM orders, c)"""


def sql_tables(spark, sf_dir):
    """The growing network, and each supplier's lines as a route, under their SQL names."""
    legs = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.sum("l_quantity").alias("weight"), F.sum("l_extendedprice").alias("length_m"))
    step = (F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey")) - 1).alias("step")
    legs = legs.select(F.col("l_suppkey").cast("string").alias("route"), step, F.col("l_orderkey").cast("string").alias("v"), F.col("weight").cast("double").alias("weight"), F.col("length_m").cast("double").alias("length_m"))
    SQL.register_tables(network(spark, sf_dir), legs)


@query(SQL_NET + ", q AS (SELECT CAST(s_suppkey AS VARCHAR) AS node FROM supplier), k AS (SELECT u, v, key, weight, row_number() OVER (PARTITION BY u ORDER BY weight, v, key) AS place FROM e) SELECT node, v, key, round(weight, 4) AS weight, CAST(place AS INTEGER) AS place FROM q JOIN k ON u = node WHERE place <= 3")
def sql_edges_from(spark, sf_dir):
    """A table function joined to a table: the three best edges on from each supplier's node."""
    sql_tables(spark, sf_dir)
    table(spark, sf_dir, "supplier").createOrReplaceTempView("asked_for")
    return rounded(spark.sql("SELECT cast(s_suppkey AS STRING) AS node, e.v, e.key, e.weight, e.place FROM asked_for, LATERAL edges_from(cast(s_suppkey AS STRING), 3) e"), "weight")


@query(SQL_NET.replace("WITH c", "WITH RECURSIVE c") + ", r(node, hops) AS (SELECT '1', 0 UNION SELECT e.v, hops + 1 FROM r JOIN e ON e.u = r.node WHERE hops < 3) SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY 1")
def sql_nodes_within(spark, sf_dir):
    """Nodes within three edges of one, by a recursive query in a table function."""
    sql_tables(spark, sf_dir)
    return spark.sql("SELECT * FROM nodes_within('1', 3)")


@query("WITH l AS (SELECT l_suppkey, l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS w, CAST(sum(l_extendedprice) AS DOUBLE) AS m FROM lineitem GROUP BY 1, 2), s AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) - 1 AS step, count(*) OVER (PARTITION BY l_suppkey) AS n FROM l) SELECT l_suppkey, CAST(step AS INTEGER) AS step, CAST(l_orderkey AS VARCHAR) AS node, round(sum(w) OVER (PARTITION BY l_suppkey ORDER BY step), 3) AS elapsed_s, round(sum(m) OVER (PARTITION BY l_suppkey ORDER BY step), 2) AS distance_m, round(100.0 * (step + 1) / n, 4) AS progress_pct FROM s")
def sql_route_timelines(spark, sf_dir):
    """The progress of every route, by a table function for each row of a table."""
    sql_tables(spark, sf_dir)
    table(spark, sf_dir, "supplier").createOrReplaceTempView("asked_for")
    t = spark.sql("SELECT s_suppkey AS l_suppkey, t.* FROM asked_for, LATERAL route_timeline(cast(s_suppkey AS STRING)) t")
    return rounded(rounded(rounded(t, "elapsed_s", places=3), "distance_m", places=2), "progress_pct")


# A sample of pairs in which seven in ten ends are of monitored nodes.

DRAWS, PAIRS = 2000, 50
_H = "CAST('0x' || substr(md5(i || '{s}'), 1, 8) AS BIGINT)"


def _draw(side: str) -> str:
    return f"CASE WHEN {_H.format(s=side + 'm')} % 100 < 70 THEN (SELECT node FROM mo WHERE k = {_H.format(s=side)} % (SELECT count(*) FROM mo)) ELSE (SELECT node FROM al WHERE k = {_H.format(s=side)} % (SELECT count(*) FROM al)) END"


@query(
    SQL_NET
    + f""", al AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) - 1 AS k FROM (SELECT u AS node FROM e UNION SELECT v FROM e)),
    mo AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) - 1 AS k FROM (SELECT CAST(o_custkey AS VARCHAR) AS node FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)),
    d AS (SELECT i, {_draw('s')} AS source, {_draw('t')} AS target FROM range({DRAWS}) t(i)),
    x AS (SELECT i, source, target, {DIST} AS metres FROM d, LATERAL (SELECT 20 + 0.0005 * (CAST(source AS BIGINT) % 89) AS lat, 85 + 0.0005 * (CAST(source AS BIGINT) % 97) AS lon) a, LATERAL (SELECT 20 + 0.0005 * (CAST(target AS BIGINT) % 89) AS lat, 85 + 0.0005 * (CAST(target AS BIGINT) % 97) AS lon) b WHERE source <> target),
    f AS (SELECT min(i) AS i, source, target, any_value(metres) AS metres FROM x WHERE metres BETWEEN 2000 AND 14000 GROUP BY 2, 3)
    SELECT i, source, target, round(metres, 3) AS metres FROM f ORDER BY i LIMIT {PAIRS}"""
)
def monitored_od_sample(spark, sf_dir):
    """Fifty pairs 2 to 14 km apart, the first that a repeatable row of draws gives; an end is monitored with a chance of seven in ten, else any node."""
    w = network(spark, sf_dir)
    every = ranks.positions(w.selectExpr("explode(array(u, v)) AS node"), ["node"], "k")
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("string").alias("node"))
    both = materialize(every.withColumn("pool", F.lit("all")).unionByName(ranks.positions(urgent, ["node"], "k").withColumn("pool", F.lit("monitored"))))
    size = {r.pool: r.n for r in both.groupBy("pool").agg(F.count("*").alias("n")).collect()}
    draws = spark.range(DRAWS).withColumnRenamed("id", "i")
    for side, name in (("s", "source"), ("t", "target")):
        h = lambda text: F.conv(F.substring(F.md5(F.concat(F.col("i").cast("string"), F.lit(text)).cast("binary")), 1, 8), 16, 10).cast("long")  # noqa: E731, B023
        pool = F.when(h(side + "m") % 100 < 70, "monitored").otherwise("all")
        n = F.when(F.col("pool") == "monitored", size.get("monitored", 0)).otherwise(size.get("all", 0))
        draws = draws.withColumn("pool", pool).withColumn("k", h(side) % n).join(both.withColumnRenamed("node", name), ["pool", "k"]).drop("pool", "k")
    at = lambda c, m: (20 if m == 89 else 85) + 0.0005 * (F.col(c).cast("long") % m)
    far = draws.where("source <> target").withColumn("metres", K.haversine(at("source", 89), at("source", 97), at("target", 89), at("target", 97))).where("metres between 2000 and 14000")
    one = far.groupBy("source", "target").agg(F.min("i").alias("i"), F.first("metres").alias("metres"))
    return rounded(one.orderBy("i").limit(PAIRS).select("i", "source", "target", "metres"), "metres", places=3)
