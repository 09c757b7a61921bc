"""Audit queries over `events` (segment = user_id) and `lineitem`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tails as P
from ..operators import audit as A
from .registry import query, rnd, rounded, table

H = "WITH h AS (SELECT user_id AS seg, date_trunc('hour', ts) AS hr, avg(value) AS speed, count(*) AS n FROM events WHERE value IS NOT NULL AND isfinite(value) GROUP BY 1, 2)"
SPAN = "span AS (SELECT min(hr) AS lo, max(hr) AS hi FROM h), spine AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hr FROM span), segs AS (SELECT count(DISTINCT seg) AS segs FROM h)"
RATED = H + ", f AS (SELECT seg, quantile_cont(speed, 0.95) AS free_flow FROM h GROUP BY seg), r AS (SELECT h.*, free_flow, CASE WHEN free_flow <> 0 THEN speed / free_flow END AS ratio FROM h JOIN f USING (seg))"
PROFILE = "count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std_samp, round(stddev_pop(value), 4) AS std_pop, round(100.0 * count(*) FILTER (value = 0) / count(value), 4) AS zeros_pct, round(quantile_cont(value, 0.5), 4) AS median, " + ", ".join(f"round(quantile_cont(value, {q}), 4) AS p{str(q)[2:]}" for q in A.QUANTILES)


def sensor(spark, sf_dir):
    return A.hourly(table(spark, sf_dir, "events"))


@query(H + ", s AS (SELECT CAST((epoch(max(hr)) - epoch(min(hr))) / 3600 + 1 AS BIGINT) AS expected FROM h) SELECT seg, count(*) AS observed, any_value(expected) AS expected, round(100.0 * count(*) / any_value(expected), 4) AS coverage_pct FROM h, s GROUP BY seg")
def coverage_by_segment(spark, sf_dir):
    return rounded(A.coverage_by_segment(sensor(spark, sf_dir)), "coverage_pct")


def _coverage_sql(part: str, name: str) -> str:
    return f"{H}, {SPAN}, a AS (SELECT {part} AS {name}, count(*) AS slots FROM spine GROUP BY 1), b AS (SELECT {part} AS {name}, count(*) AS observed, avg(speed) AS mean_speed FROM h GROUP BY 1) SELECT a.{name}, coalesce(observed, 0) AS observed, slots * segs AS expected, round(100.0 * coalesce(observed, 0) / (slots * segs), 4) AS coverage_pct, round(mean_speed, 4) AS mean_speed FROM a LEFT JOIN b USING ({name}), segs"


@query(_coverage_sql("CAST(hour(hr) AS INTEGER)", "hour"))
def coverage_by_hour(spark, sf_dir):
    return rounded(A.coverage_by(sensor(spark, sf_dir), F.hour, "hour"), "coverage_pct", "mean_speed")


@query(_coverage_sql("CAST(isodow(hr) - 1 AS INTEGER)", "weekday"))
def coverage_by_weekday(spark, sf_dir):
    return rounded(A.coverage_by(sensor(spark, sf_dir), F.weekday, "weekday"), "coverage_pct", "mean_speed")


@query(_coverage_sql("strftime(hr, '%Y-%m-%d')", "day"))
def coverage_by_date(spark, sf_dir):
    return rounded(A.coverage_by(sensor(spark, sf_dir), lambda c: F.date_format(c, "yyyy-MM-dd"), "day"), "coverage_pct", "mean_speed")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, CASE any_value(typeof({c})) WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(any_value(typeof({c}))) END AS data_type, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, count(*) AS n_rows FROM events" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")))
def column_inventory(spark, sf_dir):
    return A.column_inventory(table(spark, sf_dir, "events"))


Q = ("mean", "std_samp", "std_pop", "zeros_pct", "median", *(f"p{str(q)[2:]}" for q in A.QUANTILES))


@query(f"SELECT {PROFILE} FROM events")
def speed_profile(spark, sf_dir):
    return rounded(A.profile(table(spark, sf_dir, "events"), "value"), *Q)


@query(f"WITH e AS (SELECT *, CAST(hour(ts) AS VARCHAR) AS hour FROM events) SELECT 'event_type' AS slice, event_type AS key, {PROFILE} FROM e GROUP BY event_type UNION ALL SELECT 'hour', hour, {PROFILE} FROM e GROUP BY hour UNION ALL SELECT 'all', 'all', {PROFILE} FROM e")
def speed_profile_by_type(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("hour", F.hour("ts").cast("string"))
    return rounded(A.profile_by(e, "value", ["event_type", "hour"]), *Q)


@query("WITH e AS (SELECT event_id, user_id, date_trunc('hour', ts) AS hr FROM events) SELECT event_id, user_id, copies FROM (SELECT *, count(*) OVER (PARTITION BY user_id, hr) AS copies FROM e) WHERE copies > 1")
def duplicate_rows_involved(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.date_trunc("hour", "ts").alias("hr"))
    return A.duplicated(e, ["user_id", "hr"]).select("event_id", "user_id", "copies")


@query(RATED + " SELECT count(ratio) AS n, count(*) FILTER (ratio < 0.9) AS below_90, count(*) FILTER (ratio < 0.8) AS below_80, count(*) FILTER (ratio < 0.7) AS below_70, count(*) FILTER (ratio < 0.5) AS below_50, count(*) FILTER (abs(ratio - 1) <= 1e-9) AS equal_1, count(*) FILTER (ratio > 1 + 1e-9) AS above_1 FROM r")
def ratio_threshold_counts(spark, sf_dir):
    return A.ratio_counts(A.ratios(sensor(spark, sf_dir)))


QUALITY = "SELECT seg, avg(speed) AS mean_speed, stddev_samp(speed) AS std_speed, min(speed) AS min_speed, max(speed) AS max_speed, avg(ratio) AS mean_ratio, 100.0 * count(*) FILTER (ratio < 0.8) / count(*) AS congested_pct, count(*) AS n FROM r GROUP BY seg"


@query(RATED + f" SELECT seg, n, round(mean_speed, 4) AS mean_speed, round(std_speed, 4) AS std_speed, round(min_speed, 4) AS min_speed, round(max_speed, 4) AS max_speed, round(mean_ratio, 4) AS mean_ratio, round(congested_pct, 4) AS congested_pct FROM ({QUALITY})")
def segment_quality(spark, sf_dir):
    q = rounded(A.segment_quality(A.ratios(sensor(spark, sf_dir))), "mean_speed", "std_speed", "min_speed", "max_speed", "mean_ratio", "congested_pct")
    return q.select("seg", "n", "mean_speed", "std_speed", "min_speed", "max_speed", "mean_ratio", "congested_pct")


@query(RATED + f", q AS ({QUALITY}) SELECT count(*) AS segments, count(*) FILTER (coalesce(std_speed, 0) <= 0.1) AS near_constant, count(*) FILTER (congested_pct = 0) AS never_congested, count(*) FILTER (congested_pct > 50) AS mostly_congested FROM q")
def segment_classes(spark, sf_dir):
    return A.segment_classes(A.segment_quality(A.ratios(sensor(spark, sf_dir))))


@query("SELECT l_suppkey, count(l_tax) AS n, count(DISTINCT l_tax) AS n_distinct, min(l_tax) AS min_value, max(l_tax) AS max_value, round(stddev_samp(l_tax), 6) AS std_value, count(DISTINCT l_tax) <= 1 AS stable FROM lineitem GROUP BY 1")
def free_flow_stability(spark, sf_dir):
    return rounded(A.stability(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_tax"), "std_value", places=6)


@query(H + " SELECT count(*) AS n, count(DISTINCT seg) AS segments, count(DISTINCT hr) AS hours, count(DISTINCT (seg, hr)) AS pairs, count(*) - count(speed) AS null_speeds, count(*) = count(DISTINCT (seg, hr)) AS unique_cells, count(*) = count(DISTINCT seg) * count(DISTINCT hr) AND count(*) = count(DISTINCT (seg, hr)) AS complete FROM h")
def grid_invariants(spark, sf_dir):
    return A.grid_invariants(sensor(spark, sf_dir))


@query(H + ", s AS (SELECT count(DISTINCT seg) AS segs FROM h) SELECT strftime(hr, '%Y-%m-%d') AS day, any_value(segs) * 24 AS expected, count(*) AS present, any_value(segs) * 24 - count(*) AS missing, CAST(sum(n) AS BIGINT) AS readings, count(*) FILTER (n > 1) AS multiple, round(sum(speed), 3) AS speed_sum FROM h, s GROUP BY 1")
def daily_accounting(spark, sf_dir):
    return A.daily_accounting(sensor(spark, sf_dir)).withColumns({"day": F.date_format("day", "yyyy-MM-dd"), "speed_sum": rnd("speed_sum", 3)})


CHECK = "WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 10 AS reported_s, 3.6 * (l_quantity * 100) / (20 + 300 * l_discount) AS expected_s FROM lineitem), e AS (SELECT *, abs(reported_s - expected_s) AS error_s FROM c)"


def _checked(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / 10).alias("reported_s"), "l_quantity", "l_discount")
    return A.formula_check(li, F.col("reported_s"), F.col("l_quantity") * 100, 20 + 300 * F.col("l_discount"))


@query(CHECK + " SELECT count(error_s) AS n, round(avg(error_s), 3) AS mean_error, round(quantile_cont(error_s, 0.5), 3) AS median_error, round(max(error_s), 3) AS max_error, count(*) FILTER (error_s <= 1) AS within_1, count(*) FILTER (error_s <= 5) AS within_5, count(*) FILTER (error_s <= 0.1 * greatest(abs(expected_s), 1.0)) AS within_10pct FROM e")
def formula_consistency(spark, sf_dir):
    return rounded(A.formula_summary(_checked(spark, sf_dir)), "mean_error", "median_error", "max_error", places=3)


@query(CHECK + " SELECT l_orderkey, l_linenumber, l_partkey, round(error_s, 3) AS error_s FROM e ORDER BY e.error_s DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100")
def formula_consistency_top100(spark, sf_dir):
    top = _checked(spark, sf_dir).orderBy(F.desc("error_s"), "l_orderkey", "l_linenumber", "l_partkey").limit(100)
    return rounded(top.select("l_orderkey", "l_linenumber", "l_partkey", "error_s"), "error_s", places=3)


@query("SELECT CAST(least(greatest(floor((value - 0) / ((200.0 - 0) / 40)), 0), 39) AS BIGINT) AS bin, count(*) AS n, min(value) AS least, max(value) AS most FROM events WHERE value IS NOT NULL GROUP BY 1")
def value_histogram(spark, sf_dir):
    return A.histogram(table(spark, sf_dir, "events"), "value", 0.0, 200.0, 40)


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem WHERE l_extendedprice < 50000")
def linear_fit(spark, sf_dir):
    d = A.linear_fit(table(spark, sf_dir, "lineitem").where("l_extendedprice < 50000"), "l_extendedprice", "l_quantity")
    return d.withColumns({"slope": rnd("slope", 4), "intercept": rnd("intercept", 3), "r": rnd("r", 6)})


@query(H + ", a AS (SELECT hour(hr) AS k, avg(speed) AS m FROM h GROUP BY 1), b AS (SELECT CAST(hr AS DATE) AS d, avg(speed) AS m FROM h GROUP BY 1), u AS (SELECT CASE WHEN k BETWEEN 7 AND 9 THEN 'morning' WHEN k BETWEEN 16 AND 19 THEN 'evening' END AS part, m FROM a UNION ALL SELECT CASE WHEN isodow(d) >= 6 THEN 'weekend' ELSE 'weekday' END, m FROM b) SELECT part, round(avg(m), 4) AS mean_speed, count(*) AS n FROM u WHERE part IS NOT NULL GROUP BY part")
def window_means_weekday_weekend(spark, sf_dir):
    return rounded(A.window_means(sensor(spark, sf_dir)), "mean_speed")


@query(H + ", d AS (SELECT CAST((epoch(hr) - epoch(lag(hr) OVER (PARTITION BY seg ORDER BY hr))) / 3600 AS BIGINT) AS step_h FROM h) SELECT step_h, count(*) AS n FROM d WHERE step_h IS NOT NULL GROUP BY 1")
def cadence_counts(spark, sf_dir):
    return A.cadence(sensor(spark, sf_dir))


def _runs_sql(key: str, slots: str) -> str:
    return f", s AS ({slots}), p AS (SELECT k, s, lag(s) OVER (PARTITION BY k ORDER BY s) AS p FROM s), q AS (SELECT *, CASE WHEN p IS NULL OR s - p > 1 THEN 1 ELSE 0 END AS new FROM p), g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY s) AS run FROM q), i AS (SELECT k, run, count(*) AS length, max(CASE WHEN new = 1 THEN s - p - 1 END) AS gap FROM g GROUP BY 1, 2) SELECT k AS {key}, count(*) AS n_runs, max(length) AS longest, quantile_cont(length, 0.5) AS median_length, count(*) FILTER (gap = 1) AS gaps_1, count(*) FILTER (gap >= 2) AS gaps_2_plus, coalesce(max(gap), 0) AS max_gap FROM i GROUP BY k"


@query(H + _runs_sql("seg", "SELECT DISTINCT seg AS k, CAST(epoch(hr) / 3600 AS BIGINT) AS s FROM h"))
def run_lengths(spark, sf_dir):
    return A.run_summary(A.runs(sensor(spark, sf_dir), "seg", A.epoch("hr") / 3600), "seg")


@query(H + _runs_sql("seg", "SELECT DISTINCT seg AS k, CAST(floor(epoch(hr) / 86400) AS BIGINT) AS s FROM h"))
def day_presence_runs(spark, sf_dir):
    return A.run_summary(A.runs(sensor(spark, sf_dir), "seg", F.floor(A.epoch("hr") / 86400)), "seg")


LAGS = [1, 2, 3, 6]


def _acf_sql(least: int, src: str = "h") -> str:
    parts = " UNION ALL ".join(f"SELECT seg, {k} AS lag, speed, lead(speed, {k}) OVER w AS v, (epoch(lead(hr, {k}) OVER w) - epoch(hr)) / 3600 AS d FROM {src} WINDOW w AS (PARTITION BY seg ORDER BY hr)" for k in LAGS)
    return f", l AS ({parts}), a AS (SELECT seg, lag, count(*) AS pairs, CASE WHEN count(*) >= {least} AND stddev_pop(speed) > 1e-9 AND stddev_pop(v) > 1e-9 THEN corr(speed, v) END AS acf FROM l WHERE d = lag GROUP BY 1, 2)"


BY_TYPE = "WITH h AS (SELECT event_type AS seg, date_trunc('hour', ts) AS hr, avg(value) AS speed, count(*) AS n FROM events WHERE value IS NOT NULL AND isfinite(value) GROUP BY 1, 2)"


@query(BY_TYPE + _acf_sql(3) + " SELECT seg, CAST(lag AS INTEGER) AS lag, pairs, round(acf, 5) AS acf FROM a")
def lag_autocorrelation(spark, sf_dir):
    return rounded(A.lag_correlation(A.hourly(table(spark, sf_dir, "events"), "event_type"), LAGS), "acf", places=5)


@query(H + _acf_sql(3) + " SELECT CAST(lag AS INTEGER) AS lag, CAST(sum(pairs) AS BIGINT) AS pairs, round(sum(acf * pairs) / sum(pairs), 5) AS acf FROM a WHERE acf IS NOT NULL GROUP BY lag")
def acf_pooled(spark, sf_dir):
    return rounded(A.pooled(A.lag_correlation(sensor(spark, sf_dir), LAGS)), "acf", places=5)


@query(BY_TYPE + ", p AS (" + " UNION ALL ".join(f"SELECT a.seg, {k} AS lag, a.speed AS x, b.speed AS y FROM h a JOIN h b ON a.seg = b.seg AND b.hr = a.hr + INTERVAL {k} HOUR" for k in LAGS) + ") SELECT seg, CAST(lag AS INTEGER) AS lag, count(*) AS pairs, round(corr(x, y), 5) AS acf FROM p GROUP BY 1, 2 HAVING count(*) >= 30")
def grid_autocorrelation(spark, sf_dir):
    """Pairs an exact time apart on the grid, holes left out; at least 30 pairs."""
    h = A.hourly(table(spark, sf_dir, "events"), "event_type").select("seg", "hr", "speed")
    lagged = h.select("seg", F.explode(F.array(*map(F.lit, LAGS))).alias("lag"), "hr", F.col("speed").alias("y")).withColumn("hr", F.expr("hr - make_interval(0, 0, 0, 0, lag, 0, 0)"))
    pairs = h.join(lagged, ["seg", "hr"])
    return rounded(pairs.groupBy("seg", "lag").agg(F.count("*").alias("pairs"), P.correlation("speed", "y").alias("acf")).where("pairs >= 30"), "acf", places=5)


@query(BY_TYPE + ", e AS (SELECT quantile_cont(speed, 0.95) AS edge FROM h), d AS (SELECT *, lag(speed) OVER w AS before, epoch(hr) - epoch(lag(hr) OVER w) AS d FROM h WINDOW w AS (PARTITION BY seg, CAST(hr AS DATE) ORDER BY hr)) SELECT seg, hr, round(speed, 4) AS speed, round(before, 4) AS before FROM d, e WHERE d = 3600 AND before > 0 AND speed > edge AND speed >= 3 * before AND hour(hr) <> 0 ORDER BY d.speed DESC, seg, hr LIMIT 100")
def spike_candidates(spark, sf_dir):
    s = A.spikes(A.hourly(table(spark, sf_dir, "events"), "event_type"), 3.0, 0.95)
    return rounded(s.orderBy(F.desc("speed"), "seg", "hr").limit(100), "speed", "before")


def _many(a: str, b: str, p: str) -> str:
    return f"(SELECT count(*) AS {p}_keys, count(*) FILTER (k > 1) AS {p}_with_many, max(k) AS {p}_most FROM (SELECT {a}, count(DISTINCT {b}) AS k FROM orders GROUP BY {a}))"


@query(f"SELECT * FROM {_many('o_custkey', 'o_orderpriority', 'left')}, {_many('o_orderpriority', 'o_custkey', 'right')}")
def mapping_cardinality(spark, sf_dir):
    return A.cardinality(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")
