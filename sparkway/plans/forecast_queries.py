"""The forecast, kept and read again, and the audits of forecasts and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import features as X
from ..operators import forecast as L
from ..operators import routing as R
from ..scratch import folder, materialize
from . import road_queries as Q
from .registry import query, rounded, table

ROUNDS = 30


def prepared(spark, sf_dir):
    """Hourly values by type of event, as segments; what kind of road each is comes of its rows."""
    e = table(spark, sf_dir, "events")
    n = e.groupBy(F.col("event_type").alias("seg")).agg(F.count_distinct("user_id").alias("n"))
    kind = F.when(F.col("n") % 3 == 0, "primary").when(F.col("n") % 3 == 1, "secondary")
    level = F.when(F.col("n") % 2 == 0, "HIGH").otherwise("LOW")
    segments = n.select("seg", (10.0 * F.col("n")).alias("length_m"), kind.alias("road_type"), level.alias("confidence"))
    return materialize(L.prepare(A.hourly(e, "event_type"), 400, 100, segments))


@query()
def gbt_forecast_metrics(spark, sf_dir):
    d = prepared(spark, sf_dir)
    model, _ = L.fit(d, ROUNDS)
    p = L.predict(model, d.where("split = 'test'"))
    return rounded(X.error_metrics(X.sliced(p), ["slice"], "target", "guess"), "mae", "rmse", "r2", "median_ae", "smape")


@query()
def feature_importances(spark, sf_dir):
    """The fifteen features that the trees gain most by."""
    model, _ = L.fit(prepared(spark, sf_dir), ROUNDS)
    return rounded(spark.createDataFrame(L.importances(model), "feature string, importance double"), "importance")


@query()
def saved_model_forecast(spark, sf_dir):
    """Errors of the model that was kept and read again, a row for each split."""
    d, path = prepared(spark, sf_dir), folder(spark)
    model, trees = L.fit(d, ROUNDS)
    L.save(model, path, trees)
    again, about = L.load(spark, path)
    p = L.predict(again, d).withColumn("trees", F.lit(about["trees"]))
    return rounded(X.error_metrics(p, ["split", "trees"], "target", "guess"), "mae", "rmse", "r2", "median_ae", "smape")


@query()
def leakage_audit(spark, sf_dir):
    """Whether the forecast knows what it must not."""
    d = prepared(spark, sf_dir)
    model, _ = L.fit(d, ROUNDS)
    return L.leakage(L.predict(model, d.where("split = 'test'")), "target", "guess", L.FEATURES)


PLANS = Q.E + Q.OD + Q.WALK + Q.WIDE + f""", pc AS (SELECT od.od, b.cost AS planned_s, b.obs AS observed_s FROM od JOIN best b ON b.scenario = 'predicted' AND b.src = od.source AND b.node = od.target),
ck AS (SELECT 'mean_overlap' AS "check", avg({Q.JAC.format(a="predicted_path", b="observed_path")}) AS value, avg({Q.JAC.format(a="predicted_path", b="observed_path")}) < 1 AS passed FROM x UNION ALL SELECT 'plan_observed_gap_s', avg(abs(planned_s - observed_s)), avg(abs(planned_s - observed_s)) > 0.01 FROM pc)"""


@query(PLANS + ' SELECT "check", round(value, 4) AS value, passed FROM ck UNION ALL SELECT \'overall\', round(CAST(count(*) FILTER (NOT passed) AS DOUBLE), 4), bool_and(passed) FROM ck')
def planning_leakage_audit(spark, sf_dir):
    """Whether plans know what is only observed later: their overlap with the best routes, and their distance from what came."""
    w = Q.all_weights(spark, sf_dir)
    x = Q.wide(spark, sf_dir, w).select(R.jaccard("predicted_path", "observed_path").alias("overlap"))
    p = R.path_cost(Q.planned(spark, sf_dir, w, ("predicted",)).where("is_reached"), w.where("scenario = 'observed'"), ["od"], "observed_s")
    return rounded(L.verdict(L.planning_leakage(x, p.select(F.col("cost").alias("planned_s"), "observed_s"))), "value")
