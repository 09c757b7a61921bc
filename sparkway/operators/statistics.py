"""Correlations and paired tests, by group: moments, distributed ranks, and p-values as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tails as K
from ..scratch import join_sized, materialize
from .ranks import average_rank, with_quantiles


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman in one row."""
    d = df.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = average_rank(average_rank(d, x, "_rx"), y, "_ry")
    return r.agg(F.count("*").alias("n"), K.correlation(x, y).alias("pearson"), K.correlation("_rx", "_ry").alias("spearman"))


def correlations_by(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, n, pearson, pearson_p, spearman, spearman_p of the complete pairs of each group."""
    d = df.select(*by, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = average_rank(average_rank(d, x, "_rx", by), y, "_ry", by)
    g = r.groupBy(*by).agg(F.count("*").alias("n"), K.correlation(x, y).alias("pearson"), K.correlation("_rx", "_ry").alias("spearman"))
    p = {f"{c}_p": K.correlation_p(F.col(c), F.col("n")) for c in ("pearson", "spearman")}
    return g.withColumns(p).select(*by, "n", "pearson", "pearson_p", "spearman", "spearman_p")


def paired(df: DataFrame, a: str, b: str, by: list[str] | None = None, least: float = 1e-4) -> DataFrame:
    """Statistics of d = a - b, of each group of `by` or in one row: means, spread, interval, Cohen's d, t, skewness and kurtosis, and the signed-rank sums of |d| > least.

    Ratios to a spread of zero are null, and so are skewness and kurtosis then. Rows
    without a or b are left out.
    """
    by = by or []
    one_group = F.lit(0).alias("_all")
    keys = by or ["_all"]
    d = materialize(df.select(*(by or [one_group]), (F.col(a) - F.col(b)).alias("d")).where("d is not null"))
    centre = d.groupBy(*keys).agg(F.avg("d").alias("_m"))
    m = join_sized(d, centre, keys).withColumn("_c", F.col("d") - F.col("_m"))
    one = m.groupBy(*keys).agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("std"), F.avg(F.col("_c") ** 2).alias("m2"), F.avg(F.col("_c") ** 3).alias("m3"), F.avg(F.col("_c") ** 4).alias("m4"))
    one = with_quantiles(one, d, "d", {"median": 0.5}, keys)
    se = F.try_divide(F.col("std"), F.sqrt("n"))
    one = one.select(*keys, "n", "mean", "median", "std", (F.col("mean") - 1.96 * se).alias("ci_low"), (F.col("mean") + 1.96 * se).alias("ci_high"), F.try_divide("mean", "std").alias("cohens_d"), F.try_divide(F.col("mean"), se).alias("t"), F.try_divide(F.col("m3"), F.col("m2") ** 1.5).alias("skewness"), F.try_divide(F.col("m4"), F.col("m2") ** 2).alias("kurtosis"))
    moved = d.where(F.abs("d") > least).withColumn("_a", F.abs("d"))
    ranked = average_rank(moved, "_a", "_r", keys)
    ties = moved.groupBy(*keys, "_a").agg(F.count("*").alias("_k")).groupBy(*keys).agg(F.sum(F.col("_k") * F.col("_k") * F.col("_k") - F.col("_k")).alias("tie_sum"))
    ranks = ranked.groupBy(*keys).agg(F.count("*").alias("n_moved"), F.sum(F.when(F.col("d") > 0, F.col("_r"))).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("_r"))).alias("w_minus"))
    out = one.join(ranks, keys, "left").join(ties, keys, "left").fillna(0, ["n_moved", "w_plus", "w_minus", "tie_sum"])
    return out.drop("_all")


def small_samples(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """by and `shapiro` (w, p) of d = a - b, for the groups of at most `SMALL` rows; only these are gathered."""
    d = df.select(*by, (F.col(a) - F.col(b)).alias("d")).where("d is not null")
    few = d.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") <= K.SMALL).drop("_n")
    some = d.join(few, by, "left_semi").groupBy(*by).agg(F.array_sort(F.collect_list("d")).alias("_d"))
    return some.select(*by, K.shapiro(F.col("_d")).alias("shapiro"))


def verdicts(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """`paired` of each group with p-values, the test to rely on, and whether it is significant.

    The difference counts as normal from p = 0.05 on: by Shapiro and Wilk's test in groups
    of under 20, by the omnibus test in others. Normal differences go by the t test,
    others, and those without a p, by signed ranks.
    """
    s = paired(df, a, b, by).join(small_samples(df, a, b, by), by, "left")
    w = F.least("w_plus", "w_minus")
    s = s.withColumns({"normality_p": F.coalesce(F.col("shapiro.p"), F.when(F.col("n") > K.SMALL, K.k_squared_p(F.col("n"), F.col("skewness"), F.col("kurtosis")))), "t_p": K.t_tail(F.col("t"), (F.col("n") - 1).cast("double")), "signed_rank_p": K.signed_rank_p(F.col("n_moved"), w, F.col("tie_sum"))})
    normal = F.coalesce(F.col("normality_p") >= 0.05, F.lit(False))
    p = F.when(normal, F.col("t_p")).otherwise(F.col("signed_rank_p"))
    level = F.when(p < 0.01, "p < 0.01").when(p < 0.05, "p < 0.05").otherwise("not significant")
    return s.withColumns({"signed_rank_w": w, "primary": F.when(normal, "paired_t").otherwise("signed_rank"), "verdict": level}).drop("shapiro")
