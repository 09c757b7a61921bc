"""Feature and forecast queries over hourly means of `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import features as X
from .audit_queries import BY_TYPE, H, sensor
from .registry import query, rounded, table


def typed(spark, sf_dir):
    return A.hourly(table(spark, sf_dir, "events"), "event_type")


W = "WINDOW w AS (PARTITION BY seg ORDER BY hr)"


@query(BY_TYPE + " SELECT seg, hr, " + ", ".join(f"round(lag(speed, {k}) OVER w, 4) AS lag_{k}" for k in X.LAGS) + f", round(lead(speed) OVER w, 4) AS target, lead(hr) OVER w AS target_time FROM h {W}")
def lag_features(spark, sf_dir):
    return rounded(X.lags(typed(spark, sf_dir)).drop("speed", "n"), *(f"lag_{k}" for k in X.LAGS), "target")


@query(BY_TYPE + " SELECT a.seg, a.hr, " + ", ".join(f"round(b{k}.speed, 4) AS lag_{k}h" for k in (1, 24)) + " FROM h a " + " ".join(f"LEFT JOIN h b{k} ON b{k}.seg = a.seg AND b{k}.hr = a.hr - INTERVAL {k} HOUR" for k in (1, 24)))
def time_lag_features(spark, sf_dir):
    return rounded(X.time_lags(typed(spark, sf_dir), steps=(1, 24)).drop("speed", "n"), "lag_1h", "lag_24h")


def _roll(k: int) -> str:
    return f"OVER (PARTITION BY seg ORDER BY hr ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


@query(BY_TYPE + " SELECT seg, hr, " + ", ".join(f"round(CASE WHEN count(speed) {_roll(k)} >= {k} THEN avg(speed) {_roll(k)} END, 4) AS mean_{k}" for k in (3, 6, 24)) + ", " + ", ".join(f"round(coalesce(CASE WHEN count(speed) {_roll(k)} >= {k} THEN stddev_samp(speed) {_roll(k)} END, 0), 4) AS std_{k}" for k in (6, 24)) + " FROM h")
def rolling_features(spark, sf_dir):
    r = rounded(X.rolling(typed(spark, sf_dir)), "mean_3", "mean_6", "mean_24", "std_6", "std_24")
    return r.select("seg", "hr", "mean_3", "mean_6", "mean_24", "std_6", "std_24")


CAL = "CAST(hour(hr) AS INTEGER) AS hour, CAST(isodow(hr) - 1 AS INTEGER) AS day_of_week, isodow(hr) >= 6 AS is_weekend, (hour(hr) BETWEEN 9 AND 11 OR hour(hr) BETWEEN 17 AND 19) AS is_peak"


@query(H + f", c AS (SELECT seg, hr, {CAL} FROM h) SELECT *, round(sin(hour * 2 * pi() / 24), 6) AS hour_sin, round(cos(hour * 2 * pi() / 24), 6) AS hour_cos, round(sin(day_of_week * 2 * pi() / 7), 6) AS dow_sin, round(cos(day_of_week * 2 * pi() / 7), 6) AS dow_cos FROM c")
def calendar_features(spark, sf_dir):
    return rounded(X.calendar(sensor(spark, sf_dir).select("seg", "hr")), "hour_sin", "hour_cos", "dow_sin", "dow_cos", places=6)


@query("WITH t AS (SELECT DISTINCT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events) SELECT event_type, code, count(*) AS n FROM events JOIN t USING (event_type) GROUP BY 1, 2")
def category_codes(spark, sf_dir):
    return X.codes(table(spark, sf_dir, "events"), "event_type", "code").groupBy("event_type", "code").agg(F.count("*").alias("n"))


SPLIT = BY_TYPE + ", t AS (SELECT hr, row_number() OVER (ORDER BY hr) AS r FROM (SELECT DISTINCT hr FROM h)), s AS (SELECT h.*, CASE WHEN r <= 400 THEN 'train' WHEN r <= 500 THEN 'val' ELSE 'test' END AS split FROM h JOIN t USING (hr))"


def split(spark, sf_dir):
    return X.chronological_split(typed(spark, sf_dir), "hr", 400, 100)


@query(SPLIT + " SELECT split, count(*) AS n, count(DISTINCT hr) AS hours, min(hr) AS first_hr, max(hr) AS last_hr FROM s GROUP BY 1")
def chronological_split_counts(spark, sf_dir):
    return split(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("hr").alias("hours"), F.min("hr").alias("first_hr"), F.max("hr").alias("last_hr"))


FORECAST = SPLIT + f", x AS (SELECT *, lead(speed) OVER w AS target, lead(hr) OVER w AS target_time FROM s {W}), y AS (SELECT *, hour(target_time) AS target_hour FROM x WHERE target IS NOT NULL), m AS (SELECT seg, target_hour, avg(target) AS m FROM y WHERE split = 'train' GROUP BY 1, 2), g AS (SELECT avg(target) AS g FROM y WHERE split = 'train'), p AS (SELECT y.*, speed AS persistence, coalesce(m, g) AS historical, {CAL} FROM y LEFT JOIN m USING (seg, target_hour), g WHERE split = 'test')"


def forecast(spark, sf_dir):
    s = X.lags(split(spark, sf_dir), steps=()).where("target is not null").withColumn("target_hour", F.hour("target_time"))
    test = X.historical_mean(s.where("split = 'train'"), s.where("split = 'test'"), "target", ["seg", "target_hour"])
    return X.calendar(test.withColumn("persistence", F.col("speed")))


@query(FORECAST + " SELECT seg, hr, round(target, 4) AS target, round(persistence, 4) AS persistence, round(historical, 4) AS historical FROM p")
def historical_baseline(spark, sf_dir):
    return rounded(forecast(spark, sf_dir).select("seg", "hr", "target", "persistence", "historical"), "target", "persistence", "historical")


LONG = ", l AS (SELECT *, 'persistence' AS model, persistence AS guess FROM p UNION ALL SELECT *, 'historical', historical FROM p)"
METRICS = "count(*) AS n, round(avg(abs(target - guess)), 4) AS mae, round(sqrt(avg((target - guess) ** 2)), 4) AS rmse, round(1 - sum((target - guess) ** 2) / (sum(target * target) - count(*) * avg(target) ** 2), 4) AS r2, round(quantile_cont(abs(target - guess), 0.5), 4) AS median_ae, round(100 * avg(CASE WHEN abs(target) + abs(guess) = 0 THEN 0 ELSE 2 * abs(target - guess) / (abs(target) + abs(guess)) END), 4) AS smape"
M = ("mae", "rmse", "r2", "median_ae", "smape")


@query(FORECAST + LONG + f", z AS (SELECT *, unnest(['overall', CASE WHEN is_peak THEN 'peak' ELSE 'off_peak' END, CASE WHEN is_weekend THEN 'weekend' ELSE 'weekday' END]) AS slice FROM l) SELECT model, slice, {METRICS} FROM z GROUP BY 1, 2")
def forecast_slice_metrics(spark, sf_dir):
    long = X.by_model(X.sliced(forecast(spark, sf_dir)), ["persistence", "historical"])
    return rounded(X.error_metrics(long, ["model", "slice"], "target", "guess"), *M)


@query(FORECAST + LONG + " SELECT model, hour, round(avg(abs(target - guess)), 4) AS mae, count(*) AS n FROM l GROUP BY 1, 2")
def hourly_error(spark, sf_dir):
    long = X.by_model(forecast(spark, sf_dir), ["persistence", "historical"])
    return rounded(long.groupBy("model", "hour").agg(F.avg(F.abs(F.col("target") - F.col("guess"))).alias("mae"), F.count("*").alias("n")), "mae")


@query(FORECAST + ", e AS (SELECT seg, hr, abs(target - historical) AS err FROM p) SELECT seg, hr, round(avg(err) OVER (PARTITION BY seg ORDER BY hr ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 4) AS rolling_mae FROM e")
def rolling_error(spark, sf_dir):
    e = forecast(spark, sf_dir).select("seg", "hr", F.abs(F.col("target") - F.col("historical")).alias("err"))
    return rounded(X.trailing_mean(e, "err", "rolling_mae", 6, "seg", "hr").drop("err"), "rolling_mae")


@query(H + ", q AS (SELECT CAST(hour(hr) AS INTEGER) AS hour, strftime(hr, 'd%Y_%m_%d') AS day, round(avg(speed), 4) AS m FROM h GROUP BY 1, 2) SELECT * FROM (PIVOT q ON day USING first(m) GROUP BY hour)")
def hour_by_day_pivot(spark, sf_dir):
    """Hours down, all days across: the days are looked up first, one column each."""
    h = sensor(spark, sf_dir).withColumn("day", F.date_format("hr", "'d'yyyy_MM_dd"))
    days = sorted(r.day for r in h.select("day").distinct().collect())
    p = h.groupBy(F.hour("hr").alias("hour")).pivot("day", days).agg(F.avg("speed"))
    return rounded(p, *days)


@query("SELECT measure, l_returnflag, round(avg(v), 4) AS mean_value FROM (SELECT l_returnflag, 'l_quantity' AS measure, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem UNION ALL SELECT l_returnflag, 'l_tax', l_tax FROM lineitem) GROUP BY 1, 2")
def unpivot_means(spark, sf_dir):
    long = table(spark, sf_dir, "lineitem").unpivot(["l_returnflag"], ["l_quantity", "l_discount", "l_tax"], "measure", "v")
    return rounded(long.groupBy("measure", "l_returnflag").agg(F.avg("v").alias("mean_value")), "mean_value")


@query("WITH t AS (SELECT DISTINCT o_orderdate AS t FROM orders), q AS (SELECT DISTINCT l_shipdate AS q FROM lineitem), d AS (SELECT q, t, row_number() OVER (PARTITION BY q ORDER BY abs(epoch(t) - epoch(q)), t) AS r FROM q, t) SELECT q AS l_shipdate, t AS nearest FROM d WHERE r = 1")
def nearest_timestamp(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").select("l_shipdate").distinct()
    return X.nearest_in_time(q, table(spark, sf_dir, "orders"), "l_shipdate", "o_orderdate").select("l_shipdate", "nearest")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def latest_per_segment(spark, sf_dir):
    return X.keep_first(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), "event_id"]).select("user_id", "event_id", "event_type")


@query(H + ", t AS (SELECT hr, row_number() OVER (ORDER BY hr) - 1 AS position FROM (SELECT DISTINCT hr FROM h)) SELECT seg, hr, position, n FROM h JOIN t USING (hr) WHERE position IN (0, 10, 100, 400)")
def positional_select(spark, sf_dir):
    return X.at_positions(sensor(spark, sf_dir), "hr", [0, 10, 100, 400]).select("seg", "hr", "position", "n")


@query("SELECT e.event_id, e.user_id FROM events e WHERE e.value BETWEEN 10 AND 60 AND event_type IN ('click', 'view') AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def membership_filters(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("value").between(10, 60) & F.col("event_type").isin("click", "view"))
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return e.join(poor, "user_id", "left_anti").select("event_id", "user_id")


@query(H + ", t AS (SELECT hr, avg(speed) AS network_mean, count(*) AS segments FROM h GROUP BY 1) SELECT seg, count(*) AS n, round(avg(speed - network_mean), 4) AS mean_off, round(max(abs(speed - network_mean)), 4) AS most_off, round(avg(segments), 4) AS mean_segments FROM h LEFT JOIN t USING (hr) GROUP BY 1")
def off_network_mean(spark, sf_dir):
    """Each segment against the mean of all in the same hour: statistics of a timestamp joined back on it."""
    h = sensor(spark, sf_dir)
    off = F.col("speed") - F.col("network_mean")
    j = X.with_time_statistics(h, "hr", network_mean=F.avg("speed"), segments=F.count("*"))
    return rounded(j.groupBy("seg").agg(F.count("*").alias("n"), F.avg(off).alias("mean_off"), F.max(F.abs(off)).alias("most_off"), F.avg("segments").alias("mean_segments")), "mean_off", "most_off", "mean_segments")
