"""Statistics, components, matching, learning and streaming over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kinematics as K
from ..operators import audit as A
from ..operators import components as C
from ..operators import evaluation as V
from ..operators import features as X
from ..operators import matching as M
from ..operators import spatial as SP
from ..operators import statistics as T
from ..streaming import hourly as S
from ..scratch import folder, materialize
from . import road_queries as Q
from .audit_queries import H, sensor
from .registry import query, rnd, rounded, table

# Orders with two prices: what the order says, and what its lines add up to.
PRICES = "WITH p AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS travel_s FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, o_orderdate, o_orderpriority, o_totalprice AS baseline_s, travel_s FROM orders JOIN p ON l_orderkey = o_orderkey)"
ROBUST = "count(*) AS n, round(avg(baseline_s), 3) AS mean_baseline, round(avg(travel_s), 3) AS mean_travel, round(avg(baseline_s - travel_s), 3) AS mean_saving, round(100 * avg(baseline_s - travel_s) / avg(baseline_s), 4) AS saving_pct, round(100.0 * count(*) FILTER (baseline_s - travel_s > 1e-6) / count(*), 4) AS win_pct"


def prices(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("travel_s"))
    return table(spark, sf_dir, "orders").join(p, "o_orderkey").withColumn("baseline_s", F.col("o_totalprice"))


def robust(df, by):
    r = V.robustness(df, by, "baseline_s", "travel_s")
    return rounded(rounded(r, "mean_baseline", "mean_travel", "mean_saving", places=3), "saving_pct", "win_pct")


@query(PRICES + f" SELECT CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) <= 2 THEN 'peak' ELSE 'off_peak' END AS part, {ROBUST} FROM o GROUP BY 1")
def period_robustness(spark, sf_dir):
    d = prices(spark, sf_dir)
    return robust(d.withColumn("part", F.when(F.substring("o_orderpriority", 1, 1).cast("int") <= 2, "peak").otherwise("off_peak")), "part")


@query(PRICES + f" SELECT CASE WHEN baseline_s > 0 AND baseline_s <= 100000 THEN 0 WHEN baseline_s <= 250000 THEN 1 WHEN baseline_s <= 1000000 THEN 2 END AS bin, {ROBUST} FROM o GROUP BY 1")
def length_bin_robustness(spark, sf_dir):
    d = prices(spark, sf_dir)
    return robust(d.withColumn("bin", K.right_closed_bin(F.col("baseline_s"), [0, 100000, 250000, 1000000])), "bin")


@query(PRICES + f", q AS (SELECT quantile_cont(baseline_s, 0.33) AS a, quantile_cont(baseline_s, 0.66) AS b FROM o) SELECT CASE WHEN baseline_s <= a THEN 'low' WHEN baseline_s <= b THEN 'mid' ELSE 'high' END AS tertile, {ROBUST} FROM o, q GROUP BY 1")
def congestion_tertiles(spark, sf_dir):
    return robust(V.tertile(prices(spark, sf_dir), "baseline_s", "tertile"), "tertile")


@query("WITH d AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM d) SELECT count(*) AS n, round(corr(x, y), 5) AS pearson, round(corr(rx, ry), 5) AS spearman FROM r")
def pearson_spearman(spark, sf_dir):
    return rounded(T.correlations(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), "pearson", "spearman", places=5)


PAIRED = PRICES + ", d AS (SELECT baseline_s - travel_s AS d FROM o), c AS (SELECT avg(d) AS c FROM d), m AS (SELECT count(*) AS n, avg(d) AS mean, quantile_cont(d, 0.5) AS median, stddev_samp(d) AS std, avg((d - c) ** 2) AS m2, avg((d - c) ** 3) AS m3, avg((d - c) ** 4) AS m4 FROM d, c), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d WHERE abs(d) > 1e-4), k AS (SELECT CAST(coalesce(sum(k * k * k - k), 0) AS BIGINT) AS tie_sum FROM (SELECT count(*) AS k FROM r GROUP BY abs(d))), s AS (SELECT count(*) AS n_moved, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0) AS w_minus FROM r)"


@query(PAIRED + " SELECT n, round(mean, 3) AS mean, round(median, 3) AS median, round(std, 3) AS std, round(mean - 1.96 * std / sqrt(n), 3) AS ci_low, round(mean + 1.96 * std / sqrt(n), 3) AS ci_high, round(mean / std, 5) AS cohens_d, round(mean / (std / sqrt(n)), 4) AS t, round(m3 / m2 ** 1.5, 5) AS skewness, round(m4 / m2 ** 2, 5) AS kurtosis, n_moved, round(w_plus, 1) AS w_plus, round(w_minus, 1) AS w_minus, tie_sum FROM m, s, k")
def paired_test_statistics(spark, sf_dir):
    p = rounded(T.paired(prices(spark, sf_dir), "baseline_s", "travel_s"), "mean", "median", "std", "ci_low", "ci_high", places=3)
    return rounded(rounded(rounded(p, "cohens_d", "skewness", "kurtosis", places=5), "t"), "w_plus", "w_minus", places=1)


#: Comparison -> the orders it is made over.
COMPARISONS = {"all": "true", "finished": "o_orderstatus = 'F'", **{f"class_{k}": f"o_orderpriority LIKE '{k}%'" for k in range(1, 6)}}


def _compared(name: str, where: str) -> str:
    of = PAIRED.replace("SELECT o_orderkey, o_orderdate", "SELECT o_orderstatus, o_orderkey, o_orderdate").replace("AS d FROM o)", f"AS d FROM o WHERE {where})")
    return f"SELECT * FROM ({of} SELECT '{name}' AS comparison, n, round(mean, 3) AS mean, round(median, 3) AS median, round(std, 3) AS std, round(mean / std, 5) AS cohens_d, round(mean / (std / sqrt(n)), 4) AS t, n_moved, round(w_plus, 1) AS w_plus, round(w_minus, 1) AS w_minus FROM m, s)"


@query(" UNION ALL ".join(_compared(*c) for c in COMPARISONS.items()))
def paired_comparisons(spark, sf_dir):
    """Seven comparisons of the same kind, each over its own part of the orders."""
    p = prices(spark, sf_dir)
    parts = F.array(*(F.when(F.expr(where), F.lit(name)) for name, where in COMPARISONS.items()))
    long = p.select("baseline_s", "travel_s", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("comparison"))
    out = T.paired(long, "baseline_s", "travel_s", ["comparison"]).select("comparison", "n", "mean", "median", "std", "cohens_d", "t", "n_moved", "w_plus", "w_minus")
    return rounded(rounded(rounded(rounded(out, "mean", "median", "std", places=3), "cohens_d", places=5), "t"), "w_plus", "w_minus", places=1)


# The graph of edges over the mean length, all of them: sparse enough to fall apart.
THIN = Q.E + ", th AS (SELECT DISTINCT u, v FROM e WHERE length_m > (SELECT avg(length_m) + 1.3 * stddev_pop(length_m) FROM e)), ns AS (SELECT u AS node FROM th UNION SELECT v FROM th)"


def thin(spark, sf_dir):
    e = Q.edges(spark, sf_dir)
    edge = e.agg((F.avg("length_m") + 1.3 * F.stddev_pop("length_m")).alias("_m"))
    return e.join(F.broadcast(edge)).where("length_m > _m").select("u", "v").distinct()


@query(THIN + ", re(a, b) AS (SELECT node, node FROM ns UNION SELECT a, CASE WHEN th.u = b THEN th.v ELSE th.u END FROM re JOIN th ON th.u = b OR th.v = b) SELECT a AS node, min(b) AS component FROM re GROUP BY 1")
def weak_components(spark, sf_dir):
    return C.weak(thin(spark, sf_dir))


SCC = THIN + ", re(a, b) AS (SELECT node, node FROM ns UNION SELECT a, v FROM re JOIN th ON th.u = b), sc2 AS (SELECT x.a AS node, min(x.b) AS component FROM re x JOIN re y ON x.a = y.b AND x.b = y.a GROUP BY 1)"


@query(SCC + " SELECT node, component FROM sc2")
def strong_components(spark, sf_dir):
    s = C.strong(thin(spark, sf_dir))
    return X.keep_first(s.join(s.select("component", F.col("node").alias("_n")), "component"), ["node"], ["_n"]).select("node", F.col("_n").alias("component"))


@query(SCC + ", z AS (SELECT component, count(*) AS n FROM sc2 GROUP BY 1) SELECT n AS n_nodes, count(*) AS components FROM z GROUP BY 1")
def scc_sizes(spark, sf_dir):
    return C.sizes(C.strong(thin(spark, sf_dir))).groupBy("n_nodes").agg(F.count("*").alias("components"))


@query(THIN + ", re(a, b) AS (SELECT node, node FROM ns UNION SELECT a, CASE WHEN th.u = b THEN th.v ELSE th.u END FROM re JOIN th ON th.u = b OR th.v = b), cp AS (SELECT a, min(b) AS c FROM re GROUP BY 1), z AS (SELECT c, count(*) AS n FROM cp GROUP BY 1), y AS (SELECT count(*) AS components, max(n) AS largest, 100.0 * max(n) / sum(n) AS p FROM z) SELECT components, largest, round(p, 4) AS largest_pct, CASE WHEN p > 80 THEN 'excellent' WHEN p >= 50 THEN 'acceptable' WHEN p >= 20 THEN 'weak' ELSE 'unusable' END AS rating FROM y")
def largest_component(spark, sf_dir):
    s = C.largest_share(C.weak(thin(spark, sf_dir)))
    return rounded(s.withColumn("rating", K.component_rating(F.col("largest_pct"))), "largest_pct")


@query(Q.E + " SELECT least(u, v) AS a, greatest(u, v) AS b, round(min(length_m), 4) AS length_m, count(*) AS n_edges FROM e WHERE u <> v GROUP BY 1, 2")
def undirected_projection(spark, sf_dir):
    return rounded(C.undirected(Q.edges(spark, sf_dir)), "length_m")


@query("WITH p AS (SELECT page_id, unnest(list_distinct(list_transform(regexp_extract_all(url, '\\d+'), lambda x: CAST(x AS BIGINT)))) AS id FROM pages), q AS (SELECT p_partkey, p_size AS id FROM part) SELECT page_id, p_partkey, count(*) AS common FROM p JOIN q USING (id) GROUP BY 1, 2")
def id_list_overlap(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", M.ids_in(F.col("url")).alias("ids"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size").cast("long")).alias("ids2"))
    return M.share_an_id(pages, parts, "ids", "ids2", "page_id", "p_partkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, sha1(least('[' || l_partkey || ',' || l_suppkey || ']', '[' || l_suppkey || ',' || l_partkey || ']')) AS pair_key FROM lineitem")
def canonical_pair_hash(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", M.canonical_key(F.array("l_partkey", "l_suppkey")).alias("pair_key"))


SCORES = "WITH s AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier), c AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer), x AS (SELECT s_suppkey, c_custkey, abs(s_acctbal - c_acctbal) / 20 AS d, 0.30 * exp(-abs(s_acctbal - c_acctbal) / 20 / 50) + 0.20 * exp(-abs(ln(greatest(abs(s_acctbal), 1e-9) / greatest(abs(c_acctbal), 1e-9)))) + 0.20 * CAST(s_suppkey % 5 = c_custkey % 5 AS DOUBLE) + 0.30 * CAST(s_suppkey % 7 = c_custkey % 7 AS DOUBLE) AS score FROM s JOIN c ON s_nationkey = c_nationkey), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY round(score, 9) DESC, round(d, 9), c_custkey) AS INTEGER) AS rank FROM x)"


def match_scores(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")

    def score_of(i, x, j, y):
        import numpy as np

        a, b = np.maximum(np.abs(x), 1e-9), np.maximum(np.abs(y), 1e-9)
        return 0.30 * np.exp(-np.abs(x - y) / 1000) + 0.20 * np.minimum(a, b) / np.maximum(a, b) + 0.20 * (i % 5 == j % 5) + 0.30 * (i % 7 == j % 7)

    some = M.contenders(s.withColumnsRenamed({"s_nationkey": "g", "s_acctbal": "x"}), c.withColumnsRenamed({"c_nationkey": "g", "c_acctbal": "x"}), "g", "s_suppkey", "c_custkey", "x", score_of, 5)
    j = some.join(s, "s_suppkey").join(c, "c_custkey").where("s_nationkey = c_nationkey").withColumn("d", F.abs(F.col("s_acctbal") - F.col("c_acctbal")) / 20)
    score = M.second_score(F.col("d"), F.abs("s_acctbal"), F.abs("c_acctbal"), F.col("s_suppkey") % 5 == F.col("c_custkey") % 5, F.col("s_suppkey") % 7 == F.col("c_custkey") % 7)
    return M.top(j.withColumn("score", score), "s_suppkey", [F.desc(rnd("score", 9)), rnd("d", 9), "c_custkey"], 5)


@query(SCORES + " SELECT s_suppkey, c_custkey, rank, round(score, 5) AS score FROM r WHERE rank <= 5")
def topk_match_scores(spark, sf_dir):
    return rounded(match_scores(spark, sf_dir).select("s_suppkey", "c_custkey", "rank", "score"), "score", places=5)


@query(SCORES + ", b AS (SELECT a.s_suppkey, a.d, a.score - coalesce(b.score, 0) AS margin, abs(abs(s.s_acctbal) - abs(c.c_acctbal)) / greatest(abs(s.s_acctbal), 1e-9) AS off FROM r a JOIN supplier s ON s.s_suppkey = a.s_suppkey JOIN customer c ON c.c_custkey = a.c_custkey LEFT JOIN r b ON b.s_suppkey = a.s_suppkey AND b.rank = 2 WHERE a.rank = 1), k AS (SELECT s_suppkey, CASE WHEN off <= 0.15 AND d <= 50 AND margin >= 0.08 THEN 'HIGH' WHEN off <= 0.40 AND d <= 85 THEN 'MEDIUM' WHEN d <= 150 THEN 'LOW' END AS confidence FROM b) SELECT s_suppkey, confidence, CASE WHEN confidence IN ('HIGH', 'MEDIUM') THEN CASE WHEN s_suppkey % 2 = 0 THEN 'DYNAMIC' ELSE 'DYNAMIC_BIDIRECTIONAL' END ELSE 'STATIC_FALLBACK' END AS policy FROM k")
def match_confidence(spark, sf_dir):
    off = F.abs(F.abs("s_acctbal") - F.abs("c_acctbal")) / F.greatest(F.abs("s_acctbal"), F.lit(1e-9))
    top = match_scores(spark, sf_dir).where("rank <= 2").groupBy("s_suppkey").agg(F.max(F.when(F.col("rank") == 1, off)).alias("off"), F.max(F.when(F.col("rank") == 1, F.col("d"))).alias("d"), (F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0))).alias("margin"))
    c = top.withColumn("confidence", M.confidence(F.col("off"), F.col("d"), F.col("margin")))
    return c.select("s_suppkey", "confidence", M.eligibility(F.col("confidence"), F.col("s_suppkey") % 2 == 0).alias("policy"))


@query("SELECT a.s_nationkey, a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def pairs_within_group(spark, sf_dir):
    return M.pairs_in_group(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey")


POINTS = "WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


@query(POINTS + ", d AS (SELECT a.vec_id AS a, b.vec_id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM p a JOIN p b ON a.vec_id < b.vec_id) SELECT a, b, round(distance, 6) AS distance FROM d WHERE distance <= 0.02")
def near_point_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return rounded(SP.near_points(p, 0.02, "vec_id"), "distance", places=6)


LEG = "greatest(0, least(1, coalesce(((p.x - l.ax) * (l.bx - l.ax) + (p.y - l.ay) * (l.by_ - l.ay)) / nullif((l.bx - l.ax) ** 2 + (l.by_ - l.ay) ** 2, 0), 0)))"


@query(POINTS + f", l AS (SELECT vec_id AS line, CAST(embedding[3] AS DOUBLE) AS ax, CAST(embedding[4] AS DOUBLE) AS ay, CAST(embedding[5] AS DOUBLE) AS bx, CAST(embedding[6] AS DOUBLE) AS by_ FROM embeddings), d AS (SELECT p.vec_id AS id, l.line, sqrt((p.x - l.ax - {LEG} * (l.bx - l.ax)) ** 2 + (p.y - l.ay - {LEG} * (l.by_ - l.ay)) ** 2) AS distance FROM p, l) SELECT id, line, round(distance, 6) AS distance FROM d WHERE distance <= 0.03")
def near_lines(spark, sf_dir):
    e, at = table(spark, sf_dir, "embeddings"), lambda i: F.col("embedding")[i].cast("double")
    lines = e.select(F.col("vec_id").alias("line"), F.array(F.struct(at(2).alias("x"), at(3).alias("y")), F.struct(at(4).alias("x"), at(5).alias("y"))).alias("pts"))
    return rounded(SP.near_lines(e.select(F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y")), lines, 0.03), "distance", places=6)


@query("SELECT a.n_nationkey * 100 + b.n_nationkey AS od, round(2 * 6371000.0 * asin(sqrt(pow(sin(radians(0.01 * (b.n_nationkey - a.n_nationkey)) / 2), 2) + cos(radians(20 + 0.01 * a.n_nationkey)) * cos(radians(20 + 0.01 * b.n_nationkey)) * pow(sin(radians(0.01 * (7 * b.n_nationkey % 25 - 7 * a.n_nationkey % 25)) / 2), 2))), 3) AS metres FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey")
def od_distances(spark, sf_dir):
    n = Q.nodes(spark, sf_dir)
    a, b = n.select(F.col("node").alias("source"), F.col("lat").alias("y1"), F.col("lon").alias("x1")), n.select(F.col("node").alias("target"), F.col("lat").alias("y2"), F.col("lon").alias("x2"))
    j = Q.od(spark, sf_dir).join(a, "source").join(b, "target")
    return rounded(j.select("od", K.haversine(*(F.col(c) for c in ("y1", "x1", "y2", "x2"))).alias("metres")), "metres", places=3)


@query("SELECT CASE WHEN event_type IN ('click', 'view') THEN 'passive' ELSE 'active' END AS kind, count(*) AS n, round(avg(CAST(json_extract_string(props, '$.k') AS INTEGER)), 4) AS mean_k FROM events GROUP BY 1")
def json_properties(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    return rounded(e.groupBy(F.when(F.col("event_type").isin("click", "view"), "passive").otherwise("active").alias("kind")).agg(F.count("*").alias("n"), F.avg("k").alias("mean_k")), "mean_k")


@query("SELECT user_id FROM events INTERSECT SELECT c_custkey FROM customer EXCEPT SELECT s_suppkey FROM supplier")
def set_operations(spark, sf_dir):
    u, c, s = table(spark, sf_dir, "events").select("user_id"), table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "supplier").select("s_suppkey")
    return u.intersect(c).subtract(s)


@query(H + " SELECT seg, hr, round(speed, 4) AS speed, n FROM h")
def stream_hourly_means(spark, sf_dir):
    """The stream run to its end over the events table: hours that the watermark closed, appended once each, and those still open."""
    out = folder(spark)
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    S.hourly_means(S.replayed(e, folder(spark))).writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(spark)).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    closed = spark.read.schema("seg long, hr timestamp, speed double, n long").parquet(out)
    both = closed.unionByName(S.open_hours(e, closed))
    return rounded(both.withColumn("hr", F.col("hr").cast("timestamp_ntz")), "speed")


@query(H + " SELECT seg, hr, round(speed, 4) AS speed, n FROM h")
def batch_hourly_means(spark, sf_dir):
    return rounded(sensor(spark, sf_dir), "speed")
