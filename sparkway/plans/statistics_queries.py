"""Correlations and paired tests by group, with p-values in the plan; the SQL integrates densities and counts ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tails as K
from ..operators import routing as R
from ..operators import statistics as T
from . import road_queries as Q
from .analysis_queries import PRICES, prices
from .registry import query, rounded, table

STEPS = 20_000


def t_sql(t: str, v: str) -> str:
    """Two-sided p of Student's t: the angle's density integrated by midpoints."""
    th = f"atan(abs({t}) / sqrt({v}))"
    return f"(2 * exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0)) / sqrt(pi()) * (pi() / 2 - {th}) / {STEPS} * list_sum(list_transform(range({STEPS}), lambda i: pow(cos({th} + (pi() / 2 - {th}) * (i + 0.5) / {STEPS}), {v} - 1))))"


def normal_sql(z: str) -> str:
    """Two-sided p of the normal by midpoints."""
    return f"(2 * 12.0 / {STEPS} / sqrt(2 * pi()) * list_sum(list_transform(range({STEPS}), lambda i: exp(-pow(abs({z}) + 12.0 * (i + 0.5) / {STEPS}, 2) / 2))))"


def k2_sql(n: str = "n", s: str = "skewness", k: str = "kurtosis") -> str:
    y = f"({s} * sqrt(({n} + 1.0) * ({n} + 3) / (6.0 * ({n} - 2))))"
    b2 = f"(3.0 * ({n} * {n} + 27.0 * {n} - 70) * ({n} + 1) * ({n} + 3) / (({n} - 2.0) * ({n} + 5) * ({n} + 7) * ({n} + 9)))"
    w2 = f"(-1 + sqrt(2 * ({b2} - 1)))"
    zs = f"(asinh({y} / sqrt(2 / ({w2} - 1))) / sqrt(0.5 * ln({w2})))"
    x = f"(({k} - 3.0 * ({n} - 1) / ({n} + 1)) / sqrt(24.0 * {n} * ({n} - 2) * ({n} - 3) / (pow({n} + 1.0, 2) * ({n} + 3) * ({n} + 5))))"
    root = f"(6.0 * ({n} * {n} - 5 * {n} + 2) / (({n} + 7.0) * ({n} + 9)) * sqrt(6.0 * ({n} + 3) * ({n} + 5) / ({n} * ({n} - 2.0) * ({n} - 3))))"
    a = f"(6 + 8 / {root} * (2 / {root} + sqrt(1 + 4 / pow({root}, 2))))"
    below = f"(1 + {x} * sqrt(2 / ({a} - 4)))"
    zk = f"(((1 - 2 / (9 * {a})) - sign({below}) * pow((1 - 2 / {a}) / abs({below}), 1 / 3.0)) / sqrt(2 / (9 * {a})))"
    return f"exp(-(pow({zs}, 2) + pow({zk}, 2)) / 2)"


#: CTEs from dd(g, d): statistics of each group, and p-values.
WEIGHTS = ", ".join(f"({n}, {i}, {a!r})" for n in range(3, K.SMALL + 1) for i, a in enumerate(K.shapiro_weights(n), 1))
GROUPS = f"""
ce AS (SELECT g, avg(d) AS c FROM dd GROUP BY 1),
mo AS (SELECT g, count(*) AS n, avg(d) AS mean, quantile_cont(d, 0.5) AS median, stddev_samp(d) AS std, avg(pow(d - c, 2)) AS m2, avg(pow(d - c, 3)) AS m3, avg(pow(d - c, 4)) AS m4 FROM dd JOIN ce USING (g) GROUP BY 1),
ra AS (SELECT g, d, rank() OVER (PARTITION BY g ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, abs(d)) - 1) / 2.0 AS r FROM dd WHERE abs(d) > 1e-4),
ti AS (SELECT g, CAST(sum(k * k * k - k) AS BIGINT) AS ties FROM (SELECT g, count(*) AS k FROM ra GROUP BY g, abs(d)) GROUP BY 1),
si AS (SELECT g, count(*) AS n_moved, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0) AS w_minus FROM ra GROUP BY 1),
ks(k) AS (SELECT unnest(range(1, 26))),
wy(k, s, c) AS (SELECT 0, 0, 1.0::DOUBLE UNION ALL SELECT k + 1, s + x * (k + 1), sum(c) FROM wy, (SELECT unnest([0, 1]) AS x) z WHERE k < 25 GROUP BY k + 1, s + x * (k + 1)),
sw AS (SELECT n, i, a FROM (VALUES {WEIGHTS}) t(n, i, a)),
so AS (SELECT g, d, row_number() OVER (PARTITION BY g ORDER BY d) AS i, count(*) OVER (PARTITION BY g) AS n FROM dd),
sh AS (SELECT so.g, any_value(so.n) AS n, least(1.0, pow(sum(so.d * a), 2) / sum(pow(so.d - c, 2))) AS w FROM so JOIN ce USING (g) JOIN sw ON sw.n = so.n AND sw.i = so.i GROUP BY 1 HAVING sum(pow(so.d - c, 2)) > 0),
sz AS (SELECT g, w, n, CASE WHEN n <= 11 THEN (-ln(-2.273 + 0.459 * n - ln(1 - w)) - (0.544 - 0.39978 * n + 0.025054 * n * n - 0.0006714 * n * n * n)) / exp(1.3822 - 0.77857 * n + 0.062767 * n * n - 0.0020322 * n * n * n) ELSE (ln(1 - w) - (-1.5861 - 0.31082 * ln(n) - 0.083751 * pow(ln(n), 2) + 0.0038915 * pow(ln(n), 3))) / exp(-0.4803 - 0.082676 * ln(n) + 0.0030302 * pow(ln(n), 2)) END AS z FROM sh WHERE w < 1 AND n > 3),
shp AS (SELECT g, w, CASE WHEN z >= 0 THEN {normal_sql("z")} / 2 ELSE 1 - {normal_sql("z")} / 2 END AS p FROM sz UNION ALL SELECT g, w, greatest(0, 6 / pi() * (asin(sqrt(w)) - asin(sqrt(0.75)))) FROM sh WHERE n = 3 AND w < 1 UNION ALL SELECT g, w, 1.0 FROM sh WHERE w >= 1),
st0 AS (SELECT mo.*, mean / nullif(std, 0) AS cohens_d, mean / nullif(std / sqrt(n), 0) AS t, m3 / nullif(pow(m2, 1.5), 0) AS skewness, m4 / nullif(m2 * m2, 0) AS kurtosis, coalesce(n_moved, 0) AS n_moved, coalesce(w_plus, 0) AS w_plus, coalesce(w_minus, 0) AS w_minus, coalesce(ties, 0) AS ties FROM mo LEFT JOIN si USING (g) LEFT JOIN ti USING (g)),
st1 AS (SELECT st0.*, least(w_plus, w_minus) AS w, CASE WHEN n < 20 THEN shp.p WHEN m2 > 0 THEN {k2_sql()} END AS normality_p, CASE WHEN n > 1 THEN {t_sql("t", "(n - 1)")} END AS t_p FROM st0 LEFT JOIN shp USING (g)),
ve AS MATERIALIZED (SELECT st1.*, CASE WHEN n_moved = 0 THEN 1.0 WHEN n_moved <= 25 AND ties = 0 THEN (SELECT least(1, 2 * sum(c) / pow(2, n_moved)) FROM wy WHERE k = n_moved AND s <= floor(st1.w)) ELSE {normal_sql("((w - n_moved * (n_moved + 1) / 4.0) / sqrt(n_moved * (n_moved + 1) * (2 * n_moved + 1) / 24.0 - ties / 48.0))")} END AS signed_rank_p FROM st1)"""
VERDICT = "normality_p, 5) AS normality_p, round(t_p, 5) AS t_p, round(w, 1) AS signed_rank_w, round(signed_rank_p, 5) AS signed_rank_p, CASE WHEN normality_p >= 0.05 THEN 'paired_t' ELSE 'signed_rank' END AS \"primary\", CASE WHEN CASE WHEN normality_p >= 0.05 THEN t_p ELSE signed_rank_p END < 0.01 THEN 'p < 0.01' WHEN CASE WHEN normality_p >= 0.05 THEN t_p ELSE signed_rank_p END < 0.05 THEN 'p < 0.05' ELSE 'not significant' END AS verdict FROM ve"


def shown(v, name: str, *more: str):
    """The columns that the queries below have in common."""
    out = v.select(name, *more, "normality_p", "t_p", "signed_rank_w", "signed_rank_p", "primary", "verdict")
    return rounded(rounded(out, "normality_p", "t_p", "signed_rank_p", places=5), "signed_rank_w", places=1)


@query("WITH RECURSIVE " + PRICES[5:] + ", dd AS (SELECT 'all' AS g, baseline_s - travel_s AS d FROM o UNION ALL SELECT 'urgent', baseline_s - travel_s FROM o WHERE o_orderpriority LIKE '1%')," + GROUPS + " SELECT g AS comparison, round(" + VERDICT)
def paired_test_verdicts(spark, sf_dir):
    """What the orders say against what their lines add up to: p-values, the test to rely on, and its verdict."""
    p = prices(spark, sf_dir)
    both = p.withColumn("comparison", F.lit("all")).unionByName(p.where("o_orderpriority like '1%'").withColumn("comparison", F.lit("urgent")))
    return shown(T.verdicts(both, "baseline_s", "travel_s", ["comparison"]), "comparison")


COMPARED = {"predicted vs static": ("static", "predicted"), "historical vs static": ("static", "historical"), "persistence vs static": ("static", "persistence"), "predicted vs historical": ("historical", "predicted"), "predicted vs persistence": ("persistence", "predicted"), "observed vs static": ("static", "observed")}
_PAIRS = " UNION ALL ".join(f"SELECT '{n}' AS g, a.t - b.t AS d FROM tt a JOIN tt b USING (od) WHERE a.scenario = '{x}' AND b.scenario = '{y}'" for n, (x, y) in COMPARED.items())
STRATEGIES = Q.E5 + Q.OD + Q.WALK + Q.REPLAY + f", tt AS (SELECT od.od, r.scenario, r.obs AS t FROM od JOIN best r ON r.src = od.source AND r.node = od.target), dd AS ({_PAIRS} UNION ALL SELECT 'rerouted vs not', no_reroute_s - (prefix_s + CASE WHEN saving_s >= 10 AND saving_pct >= 3 THEN best_s ELSE remaining_s END) FROM jr)," + GROUPS


def compared(spark, sf_dir):
    """comparison, a_s, b_s: two strategies' times of each pair, and of each replay with and without the change of route."""
    w = Q.all_weights(spark, sf_dir, more=True)
    r = R.path_cost(Q.planned(spark, sf_dir, w, Q.STRATEGIES).where("is_reached"), w.where("scenario = 'observed'"), ["od", "scenario"], "travel_s")
    wide = r.groupBy("od").pivot("scenario", list(Q.STRATEGIES)).agg(F.first("travel_s"))
    sides = F.array(*(F.struct(F.lit(n).alias("comparison"), F.col(x).alias("a_s"), F.col(y).alias("b_s")) for n, (x, y) in COMPARED.items()))
    replay = Q.replays(spark, sf_dir).select(F.lit("rerouted vs not").alias("comparison"), F.col("no_reroute_s").alias("a_s"), F.col("dynamic_s").alias("b_s"))
    return wide.select(F.inline(sides)).unionByName(replay)


@query(STRATEGIES + " SELECT g AS comparison, n, round(mean, 3) AS mean, round(median, 3) AS median, round(cohens_d, 4) AS cohens_d, round(" + VERDICT)
def strategy_tests(spark, sf_dir):
    """The seven comparisons of strategies."""
    v = T.verdicts(compared(spark, sf_dir), "a_s", "b_s", ["comparison"])
    return rounded(rounded(shown(v, "comparison", "n", "mean", "median", "cohens_d"), "mean", "median", places=3), "cohens_d")


@query("WITH RECURSIVE dd AS (SELECT s_nationkey AS g, s_acctbal - 10.0 * s_suppkey AS d FROM supplier)," + GROUPS + " SELECT g AS s_nationkey, n, round(" + VERDICT)
def small_sample_verdicts(spark, sf_dir):
    """Few suppliers a nation: normality by the test for small samples."""
    s = table(spark, sf_dir, "supplier").withColumn("b", 10.0 * F.col("s_suppkey"))
    return shown(T.verdicts(s, "s_acctbal", "b", ["s_nationkey"]), "s_nationkey", "n")


RHO = "WITH d AS (SELECT c_nationkey AS g, c_acctbal AS x, CAST((c_custkey * 7919) % 1009 AS DOUBLE) AS y FROM customer), r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry FROM d), c AS (SELECT g, count(*) AS n, corr(x, y) AS r, corr(rx, ry) AS s FROM r GROUP BY 1), t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS tr, s * sqrt((n - 2) / (1 - s * s)) AS ts FROM c)"


@query(RHO + f" SELECT g AS c_nationkey, n, round(r, 5) AS pearson, round(CASE WHEN n > 2 THEN {t_sql('tr', '(n - 2)')} END, 5) AS pearson_p, round(s, 5) AS spearman, round(CASE WHEN n > 2 THEN {t_sql('ts', '(n - 2)')} END, 5) AS spearman_p FROM t")
def correlation_tests(spark, sf_dir):
    """Correlations by nation with their p-values."""
    c = table(spark, sf_dir, "customer").withColumn("y", (F.col("c_custkey") * 7919 % 1009).cast("double"))
    return rounded(T.correlations_by(c, "c_acctbal", "y", ["c_nationkey"]), "pearson", "pearson_p", "spearman", "spearman_p", places=5)
