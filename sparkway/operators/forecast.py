"""Next-hour forecast by gradient-boosted trees: features, training with early stopping, models kept and read again, audits against leakage.

A segment table (seg, length_m, road_type, confidence) is a left join: what is missing is
-1 or the code of nothing. Rows without a target or without full windows are left out, and
so are hours without a value. Empty tables give no rows; a model needs rows to train and
to validate.
"""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize
from . import features as X
from . import ranks

#: Of the calendar, lags, windows, the present, the segment, and the past of the target hour.
FEATURES = ["hour", "day_of_week", "weekend", "hour_sin", "hour_cos", "dow_sin", "dow_cos", *(f"lag_{k}" for k in X.LAGS), "mean_3", "mean_6", "mean_24", "std_6", "std_24", "speed", "free_flow", "speed_ratio", "length_m", "road_code", "confidence_code", "historical"]
CONFIDENCE = ("LOW", "MEDIUM", "HIGH")
# Fixed values, which results must share: speeds that a forecast is kept within, and name parts that features must not have.
LEAST_KMH, MOST_KMH = 3.0, 120.0
FORBIDDEN = ("target", "actual", "future", "lead", "t_plus", "ground_truth")


def prepare(sensor: DataFrame, train: int, validation: int, segments: DataFrame | None = None) -> DataFrame:
    """Complete rows (seg, hr, FEATURES, target, split). Free flow and the historical mean are learned from the training rows alone."""
    d = X.rolling(X.lags(X.chronological_split(sensor, "hr", train, validation)))
    d = X.calendar(d).withColumn("weekend", F.col("is_weekend").cast("double")).withColumn("target_hour", (F.col("hour") + 1) % 24)
    d = materialize(d.where("target is not null"))
    known = d.where("split = 'train'")
    free = ranks.quantiles(known, "speed", {"free_flow": 0.95}, ["seg"])
    d = d.join(free, "seg", "left").withColumn("speed_ratio", F.coalesce(F.try_divide("speed", "free_flow"), F.lit(1.0)))
    d = X.historical_mean(known, d, "target", ["seg", "target_hour"])
    if segments is None:
        d = d.withColumns({"length_m": F.lit(-1.0), "road_type": F.lit(None).cast("string"), "confidence": F.lit(None).cast("string")})
    else:
        d = d.join(segments.select("seg", F.col("length_m").cast("double").alias("length_m"), "road_type", "confidence"), "seg", "left")
    level = F.lit(-1)
    for i, c in enumerate(CONFIDENCE):
        level = F.when(F.col("confidence") == c, i).otherwise(level)
    d = X.codes(d, "road_type", "road_code").withColumns({"confidence_code": level, "length_m": F.coalesce("length_m", F.lit(-1.0)), "free_flow": F.coalesce("free_flow", F.lit(-1.0))})
    return d.dropna(subset=["target", *FEATURES]).select("seg", "hr", *FEATURES, "target", "split", "is_peak", "is_weekend")


def fit(prepared: DataFrame, rounds: int = 100, depth: int = 4, patience: int = 50) -> tuple[PipelineModel, int]:
    """(model, trees): trained on the training rows; as many trees as gave the least validation error before `patience` more gave none less.

    Trees come one after the other, so a model of k trees is the first k of a longer one.
    """
    rows = materialize(prepared.select(*FEATURES, "target", "split"))

    def grown(n: int) -> PipelineModel:
        model = GBTRegressor(featuresCol="x", labelCol="target", predictionCol="guess", maxIter=n, maxDepth=depth, stepSize=0.1, seed=42)
        return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="x"), model]).fit(rows.where("split = 'train'"))

    model, tried = grown(min(rounds, 2 * patience)), min(rounds, 2 * patience)
    while True:
        best = best_of(model, rows, patience)
        if tried >= rounds or best + patience <= tried:
            break
        tried = min(rounds, 2 * tried)
        model = grown(tried)
    return (model if best == tried else grown(best)), best


def best_of(model: PipelineModel, rows: DataFrame, patience: int) -> int:
    """Trees after which the validation error was least, none of the next `patience` giving less."""
    errors = model.stages[-1].evaluateEachIteration(model.stages[0].transform(rows.where("split = 'val'")), "squared")
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def predict(model: PipelineModel, rows: DataFrame, lo: float = LEAST_KMH, hi: float = MOST_KMH) -> DataFrame:
    return model.transform(rows).withColumn("guess", F.greatest(F.lit(lo), F.least(F.lit(hi), F.col("guess")))).drop("x")


def importances(model: PipelineModel, k: int = 15) -> list[tuple[str, float]]:
    w = model.stages[-1].featureImportances.toArray()
    return sorted(zip(FEATURES, map(float, w), strict=True), key=lambda p: (-p[1], p[0]))[:k]


def save(model: PipelineModel, path: str, trees: int) -> None:
    """The model, and beside it what it expects: names and order of its features, and how many trees it has."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    about = json.dumps({"features": FEATURES, "trees": trees, "target": "target", "least": LEAST_KMH, "most": MOST_KMH})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """The model kept at a path and what it expects; an error if the two, or this library's features, don't agree."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    model = PipelineModel.load(f"{path}/model")
    if about["features"] != FEATURES or model.stages[0].getInputCols() != FEATURES or model.stages[-1].getNumTrees != about["trees"]:
        raise ValueError(f"the model at {path} was made for other features")
    return model, about


def check(name: str, value, passed):
    """One row of an audit."""
    return F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"), passed.alias("passed"))


def leakage(rows: DataFrame, truth: str, guess: str, features: list[str], forbidden=FORBIDDEN) -> DataFrame:
    """check, value, passed of a forecast: forbidden names among the features, and guesses too good to be true."""
    bad = sum(any(t in f.lower() for t in forbidden) for f in features)
    one = rows.agg((100.0 * F.count_if(F.col(truth) == F.col(guess)) / F.count("*")).alias("exact"), F.avg(F.abs(F.col(truth) - F.col(guess))).alias("mae"))
    checks = F.array(check("forbidden_features", F.lit(float(bad)), F.lit(bad == 0)), check("exact_match_pct", F.col("exact"), F.col("exact") < 5), check("mae", F.col("mae"), F.col("mae") > 0.1))
    return one.select(F.inline(checks))


def planning_leakage(overlaps: DataFrame, replays: DataFrame) -> DataFrame:
    """check, value, passed of plans: overlaps (overlap of predicted and best routes) not all whole, replays' plans (planned_s) apart from what was observed (observed_s)."""
    a = overlaps.agg(F.avg("overlap").alias("o"))
    b = replays.agg(F.avg(F.abs(F.col("planned_s") - F.col("observed_s"))).alias("d"))
    return a.join(F.broadcast(b)).select(F.inline(F.array(check("mean_overlap", F.col("o"), F.col("o") < 1), check("plan_observed_gap_s", F.col("d"), F.col("d") > 0.01))))


def verdict(checks: DataFrame) -> DataFrame:
    """`checks` and a row for all of them."""
    all_ = checks.agg(F.count_if(~F.col("passed")).cast("double").alias("value"), F.bool_and("passed").alias("passed")).select(F.lit("overall").alias("check"), "value", "passed")
    return checks.unionByName(all_)
