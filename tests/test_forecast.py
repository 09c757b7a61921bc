"""Features, early stopping, kept models and audits of the forecast."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkway.operators import forecast as L


@pytest.fixture(scope="module")
def prepared(spark):
    rng = random.Random(1)
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    rows = [(s, at(h), 40 + 15 * math.sin(h / 24 * 2 * math.pi) + 5 * i + rng.gauss(0, 1)) for i, s in enumerate("abc") for h in range(240)]
    segments = spark.createDataFrame([("a", 100.0, "primary", "HIGH"), ("b", 250.0, None, "LOW")], "seg string, length_m double, road_type string, confidence string")
    return L.prepare(spark.createDataFrame(rows, "seg string, hr timestamp, speed double"), 150, 40, segments)


def test_features(prepared):
    assert len(L.FEATURES) == len(set(L.FEATURES)) == 25 and set(L.FEATURES) <= set(prepared.columns)
    rows = prepared.where("hr = timestamp'2024-01-05 07:00:00'").collect()
    by = {r.seg: r for r in rows}
    assert {s: (r.length_m, r.road_code, r.confidence_code) for s, r in by.items()} == {"a": (100.0, 0, 2), "b": (250.0, -1, 0), "c": (-1.0, -1, -1)}
    assert all(r.hour == 7 and r.day_of_week == 4 and r.weekend == 0 and r.split == "train" for r in rows)
    known = prepared.where("split = 'train' and seg = 'a'").collect()
    top = sorted(r.speed for r in known)
    assert by["a"].speed_ratio == pytest.approx(by["a"].speed / by["a"].free_flow) and top[-30] <= by["a"].free_flow <= top[-1]


def test_what_is_learned_comes_of_training_rows(prepared):
    """Free flow and the historical mean don't move when later rows do."""
    means = {(r.seg, r.hour): r.historical for r in prepared.select("seg", "hour", "historical").distinct().collect()}
    train = prepared.where("split = 'train'").groupBy("seg", "hour").agg(F.avg("target").alias("m")).collect()
    close = [abs(means[r.seg, r.hour] - r.m) for r in train]
    assert max(close) < 3 and len(means) == 72


def test_early_stopping_keeps_the_best_trees(prepared):
    model, trees = L.fit(prepared, rounds=30, depth=3, patience=3)
    assert 1 <= trees <= 30 and model.stages[-1].getNumTrees == trees
    errors = model.stages[-1].evaluateEachIteration(model.stages[0].transform(prepared.where("split = 'val'")), "squared")
    assert min(errors) == errors[-1]
    assert sum(w for _, w in L.importances(model, 25)) == pytest.approx(1.0) and len(L.importances(model, 5)) == 5


def test_a_model_kept_and_read_again(spark, prepared, tmp_path):
    model, trees = L.fit(prepared, rounds=5, depth=3, patience=5)
    L.save(model, f"file://{tmp_path}/m", trees)
    again, about = L.load(spark, f"file://{tmp_path}/m")
    assert about["trees"] == trees and about["features"] == L.FEATURES
    test = prepared.where("split = 'test'")
    a, b = ({(r.seg, r.hr): r.guess for r in L.predict(m, test).collect()} for m in (model, again))
    assert a == b and all(L.LEAST_KMH <= x <= L.MOST_KMH for x in a.values())
    spark.createDataFrame([('{"features": ["hour"], "trees": 5}',)], "value string").coalesce(1).write.mode("overwrite").text(f"file://{tmp_path}/m/about")
    with pytest.raises(ValueError, match="other features"):
        L.load(spark, f"file://{tmp_path}/m")


def test_leakage_checks(spark):
    d = spark.createDataFrame([(float(i), float(i) + (0.0 if i < 2 else 1.0)) for i in range(10)], "t double, g double")
    got = {r.check: (r.value, r.passed) for r in L.leakage(d, "t", "g", ["speed", "lead_speed", "actual"]).collect()}
    assert got == {"forbidden_features": (2.0, False), "exact_match_pct": (20.0, False), "mae": (pytest.approx(0.8), True)}
    whole, part = (spark.createDataFrame([(x,) for x in xs], "overlap double") for xs in ([1.0, 1.0], [1.0, 0.5]))
    same, off = (spark.createDataFrame([(10.0, x)], "planned_s double, observed_s double") for x in (10.0, 12.0))
    assert [r.passed for r in L.verdict(L.planning_leakage(part, off)).collect()] == [True] * 3
    assert {r.check: (r.value, r.passed) for r in L.verdict(L.planning_leakage(whole, same)).collect()} == {"mean_overlap": (1.0, False), "plan_observed_gap_s": (0.0, False), "overall": (2.0, False)}
