"""Experiment analytics: strategies against each other, policies, grids, robustness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import quantiles, with_quantiles

TIE_S = 1e-6


def long_form(wide: DataFrame, keys: list[str], strategies: list[str]) -> DataFrame:
    """keys, baseline, oracle and a row for each strategy's travel_s."""
    return wide.unpivot([*keys, "baseline_s", "oracle_s"], strategies, "strategy", "travel_s")


def strategy_summary(long: DataFrame) -> DataFrame:
    """Means, spread, 95 % interval, savings, win/tie/loss shares against the baseline, regret against the oracle."""
    d = F.col("baseline_s") - F.col("travel_s")
    n = F.count("*")
    std = F.stddev_samp("travel_s")
    half = 1.96 * std / F.sqrt(n)
    share = lambda c: 100.0 * F.count_if(c) / n
    out = long.groupBy("strategy").agg(
        n.alias("n"), F.avg("travel_s").alias("mean_s"), std.alias("std_s"), (F.avg("travel_s") - half).alias("ci_low"), (F.avg("travel_s") + half).alias("ci_high"),
        F.avg(d).alias("mean_saving"), share(d > TIE_S).alias("win_pct"), share(F.abs(d) <= TIE_S).alias("tie_pct"), share(d < -TIE_S).alias("loss_pct"), F.avg(F.greatest(F.col("travel_s") - F.col("oracle_s"), F.lit(0.0))).alias("mean_regret"), (100 * F.avg(F.try_divide(F.col("travel_s") - F.col("oracle_s"), "oracle_s"))).alias("gap_pct"),
    )
    return placed(with_quantiles(out, long, "travel_s", {"median_s": 0.5}, ["strategy"]), "median_s", 3)


def placed(df: DataFrame, column: str, at: int) -> DataFrame:
    """The column moved to a place among the others."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest[:at], column, *rest[at:])


def policy_summary(facts: DataFrame, policies: DataFrame) -> DataFrame:
    """Each policy (policy, min_s, min_pct) over all replays (saving_s, saving_pct, no_reroute_s): a bounded grid against the facts."""
    j = facts.crossJoin(F.broadcast(policies))
    hit = (F.col("saving_s") >= F.col("min_s")) & (F.col("saving_pct") >= F.col("min_pct"))
    got = F.when(hit, F.col("saving_s")).otherwise(0.0)
    out = j.groupBy("policy", "min_s", "min_pct").agg(
        F.count("*").alias("n"), F.count_if(hit).alias("reroutes"), (100.0 * F.count_if(hit) / F.count("*")).alias("reroute_pct"), (100.0 * F.count_if(hit & (F.col("saving_s") > 0)) / F.count("*")).alias("beneficial_pct"), (100.0 * F.count_if(hit & (F.col("saving_s") < 0)) / F.count("*")).alias("detrimental_pct"),
        F.avg(got).alias("mean_saving"), F.avg(F.when(hit, F.col("saving_s"))).alias("mean_saving_hit"), F.avg(F.col("no_reroute_s") - got).alias("mean_journey_s"),
    )
    return placed(with_quantiles(out, j.withColumn("_got", got), "_got", {"median_saving": 0.5}, ["policy", "min_s", "min_pct"]), "median_saving", 9)


def grid(spark, seconds: list[float], percents: list[float]) -> DataFrame:
    """All threshold pairs, as a literal table."""
    return spark.createDataFrame([(f"{s:g}s_{p:g}pct", float(s), float(p)) for s in seconds for p in percents], "policy string, min_s double, min_pct double")


def tertile(df: DataFrame, value: str, name: str, shares=(0.33, 0.66)) -> DataFrame:
    """low / mid / high by exact quantiles, edges belonging to the lower part."""
    q = quantiles(df, value, {"_q0": shares[0], "_q1": shares[1]})
    return df.join(F.broadcast(q)).withColumn(name, F.when(F.col(value) <= F.col("_q0"), "low").when(F.col(value) <= F.col("_q1"), "mid").otherwise("high")).drop("_q0", "_q1")


def robustness(df: DataFrame, by: str | Column, baseline: str, travel: str) -> DataFrame:
    d = F.col(baseline) - F.col(travel)
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(baseline).alias("mean_baseline"), F.avg(travel).alias("mean_travel"), F.avg(d).alias("mean_saving"), (100 * F.try_divide(F.avg(d), F.avg(baseline))).alias("saving_pct"), (100.0 * F.count_if(d > TIE_S) / F.count("*")).alias("win_pct"))


def mapping_summary(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("policy").agg(F.count("*").alias("n"), F.count_distinct("u", "v", "key").alias("edges"))


def period_summary(x: DataFrame, period: str) -> DataFrame:
    """Routes by period: means, median saving, wins, predictions within 5 s of the best, mean overlap with the best route."""
    saving = F.col("static_s") - F.col("predicted_s")
    share = lambda c: 100.0 * F.count_if(c) / F.count("*")
    out = x.groupBy(period).agg(F.count("*").alias("n"), F.avg("static_s").alias("mean_static"), F.avg("predicted_s").alias("mean_predicted"), share(saving > 1e-6).alias("win_pct"), share(F.abs(F.col("predicted_s") - F.col("observed_s")) <= 5).alias("within_5s_pct"), F.avg("overlap").alias("mean_overlap"))
    return placed(with_quantiles(out, x.withColumn("_saving", saving), "_saving", {"median_saving": 0.5}, [period]), "median_saving", 4)


def percent_in(text: str) -> Column:
    """The first number before a percent sign, or null."""
    return F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*%", 1).try_cast("double")
