"""Forecast features, splits, baselines and error metrics for hourly series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import join_sized
from . import ranks

LAGS = (1, 2, 3, 6, 12, 24)


def by_segment(key: str = "seg", time: str = "hr"):
    return Window.partitionBy(key).orderBy(time)


def lags(df: DataFrame, value: str = "speed", steps=LAGS, key: str = "seg", time: str = "hr") -> DataFrame:
    """Row lags, and the next row's value as `target`; gaps in time are not looked at."""
    w = by_segment(key, time)
    return df.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in steps} | {"target": F.lead(value, 1).over(w), "target_time": F.lead(time, 1).over(w)})


def time_lags(df: DataFrame, value: str = "speed", steps=LAGS, key: str = "seg", time: str = "hr") -> DataFrame:
    """Lags by time: the value exactly k hours before, or null."""
    s = F.unix_timestamp(time)
    w = Window.partitionBy(key).orderBy(s)
    return df.withColumns({f"lag_{k}h": F.max(value).over(w.rangeBetween(-3600 * k, -3600 * k)) for k in steps})


def rolling(df: DataFrame, value: str = "speed", means=(3, 6, 24), stds=(6, 24), key: str = "seg", time: str = "hr") -> DataFrame:
    """Means over the last k rows, null until there are k; sample deviations likewise, null as 0."""
    out = {}
    for k in sorted({*means, *stds}):
        w = by_segment(key, time).rowsBetween(-(k - 1), 0)
        full = F.count(value).over(w) >= k
        if k in means:
            out[f"mean_{k}"] = F.when(full, F.avg(value).over(w))
        if k in stds:
            out[f"std_{k}"] = F.coalesce(F.when(full, F.stddev_samp(value).over(w)), F.lit(0.0))
    return df.withColumns(out)


def trailing_mean(df: DataFrame, value: str, name: str, rows: int, key: str | None, time: str) -> DataFrame:
    """Mean over up to `rows` rows, from the first on."""
    w = (Window.partitionBy(key) if key else Window).orderBy(time).rowsBetween(-(rows - 1), 0)
    return df.withColumn(name, F.avg(value).over(w))


PEAK = ((9, 11), (17, 19))


def is_peak(hour: Column, peaks=PEAK) -> Column:
    out = F.lit(False)
    for lo, hi in peaks:
        out = out | hour.between(lo, hi)
    return out


def calendar(df: DataFrame, time: str = "hr", zone: str | None = None, peaks=PEAK) -> DataFrame:
    """hour, day of week (Monday 0), weekend and peak flags, and both cycles as sine and cosine; in `zone` if given."""
    t = F.from_utc_timestamp(time, zone) if zone else F.col(time)
    d = df.withColumns({"hour": F.hour(t), "day_of_week": F.weekday(t)})
    turn = lambda c, n: F.col(c) * (2 * math.pi / n)
    return d.withColumns({"is_weekend": F.col("day_of_week") >= 5, "is_peak": is_peak(F.col("hour"), peaks), "hour_sin": F.sin(turn("hour", 24)), "hour_cos": F.cos(turn("hour", 24)), "dow_sin": F.sin(turn("day_of_week", 7)), "dow_cos": F.cos(turn("day_of_week", 7))})


def codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """Codes by alphabetical order from 0, null as -1; the distinct values are ranked in ranges, then joined back."""
    ranked = ranks.positions(df.where(F.col(column).isNotNull()), [column], name)
    return join_sized(df, ranked, [column]).withColumn(name, F.coalesce(F.col(name).cast("int"), F.lit(-1)))


def chronological_split(df: DataFrame, time: str, train: int, validation: int) -> DataFrame:
    """train / val / test by the rank of the distinct timestamp; ranks come from the distinct times alone."""
    part = F.when(F.col("_r") < train, "train").when(F.col("_r") < train + validation, "val").otherwise("test")
    return ranks.with_position(df, time, "_r").withColumn("split", part).drop("_r")


def historical_mean(train: DataFrame, rows: DataFrame, value: str, keys: list[str], name: str = "historical") -> DataFrame:
    """Mean of the training rows with the same keys, else the mean of all of them."""
    cell = train.groupBy(*keys).agg(F.avg(value).alias("_m"))
    all_ = train.agg(F.avg(value).alias("_a"))
    return rows.join(cell, keys, "left").join(F.broadcast(all_)).withColumn(name, F.coalesce("_m", "_a")).drop("_m", "_a")


def error_metrics(df: DataFrame, by: list[str], truth: str, guess: str) -> DataFrame:
    """n, mae, rmse, r2, median_ae and smape of each group; rows without truth or guess count in n alone."""
    t, g = F.col(truth), F.col(guess)
    sse, n = F.sum((t - g) ** 2), F.count("*")
    sst = F.sum(t * t) - n * F.avg(t) ** 2
    both = F.abs(t) + F.abs(g)
    out = df.groupBy(*by).agg(n.alias("n"), F.avg(F.abs(t - g)).alias("mae"), F.sqrt(F.avg((t - g) ** 2)).alias("rmse"), (1 - F.try_divide(sse, sst)).alias("r2"), (100 * F.avg(F.when(both == 0, 0.0).otherwise(F.try_divide(2 * F.abs(t - g), both)))).alias("smape"))
    out = ranks.with_quantiles(out, df.select(*by, F.abs(t - g).alias("_e")), "_e", {"median_ae": 0.5}, by)
    return out.select(*by, "n", "mae", "rmse", "r2", "median_ae", "smape")


def sliced(df: DataFrame) -> DataFrame:
    """One row for each slice a row is in: overall, peak or off-peak, weekday or weekend."""
    s = F.array(F.lit("overall"), F.when(F.col("is_peak"), "peak").otherwise("off_peak"), F.when(F.col("is_weekend"), "weekend").otherwise("weekday"))
    return df.withColumn("slice", F.explode(s))


def by_model(df: DataFrame, models: list[str]) -> DataFrame:
    """Long form: a row for each model's guess."""
    keep = [c for c in df.columns if c not in models]
    return df.unpivot(keep, models, "model", "guess")


def nearest_in_time(requests: DataFrame, times: DataFrame, request: str, time: str) -> DataFrame:
    """The nearest of the distinct times for each requested one; the earlier wins ties.

    Distinct times of both sides are merged into one order, in ranges, along which
    the last and the next known time are carried. Null times have no nearest.
    """
    t = times.select(F.col(time).alias("_t")).distinct()
    r = requests.select(F.col(request).alias("_t")).distinct().withColumn("_q", F.lit(True))
    both = t.withColumn("_q", F.lit(False)).unionByName(r)
    known = both.where("_t is not null").withColumn("_known", F.when(~F.col("_q"), F.col("_t")))
    both = ranks.carried(known, ["_t", "_q"], "_known").where("_q").withColumnsRenamed({"lo": "_lo", "hi": "_hi"})
    gap = lambda c: F.abs(F.unix_micros(F.col(c).cast("timestamp")) - F.unix_micros(F.col("_t").cast("timestamp")))
    best = F.when(F.col("_hi").isNull() | (gap("_lo") <= gap("_hi")), F.col("_lo")).otherwise(F.coalesce("_hi", "_lo"))
    return requests.join(both.select(F.col("_t").alias(request), best.alias("nearest")), request)


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def at_positions(df: DataFrame, order: str, positions: list[int]) -> DataFrame:
    """Rows at positions (from 0) of the distinct values of `order`."""
    ranked = ranks.positions(df, [order], "position").where(F.col("position").isin(positions)).withColumn("position", F.col("position").cast("int"))
    return df.join(F.broadcast(ranked), order)  # a row for each position asked for


def closed_range(df: DataFrame, time: str, low: str, high: str) -> DataFrame:
    """Rows with a time from `low` to `high`, both included."""
    kind = df.schema[time].dataType
    return df.where(F.col(time).between(F.lit(low).cast(kind), F.lit(high).cast(kind)))


def drop_suffixes(df: DataFrame, suffixes: list[str]) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in df.columns if not c.endswith(tuple(suffixes))))


def finite_or_null(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def first_known(value: str, order: Column) -> Column:
    """Aggregate: the first value in order that isn't null."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), order))


def with_time_statistics(df: DataFrame, time: str, **aggregates: Column) -> DataFrame:
    """`df` with statistics of all rows of the same time. Rows without a time have those of none: null."""
    return join_sized(df, df.where(F.col(time).isNotNull()).groupBy(time).agg(*(c.alias(n) for n, c in aggregates.items())), [time])
