"""Data-quality audits of sensor tables: coverage, gaps, runs, lag correlation, distributions.

A sensor table has one row per (segment, hour) that was observed. Empty cells of
the full grid aren't stored: expected counts come from the spine's size, so a
sparse table of N rows never grows to segments x hours rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tails as K
from . import ranks

HOUR_S = 3600


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def hourly(events: DataFrame, segment: str = "user_id") -> DataFrame:
    """seg, hr, speed (mean of finite values), n."""
    return events.where(finite(F.col("value"))).groupBy(F.col(segment).alias("seg"), F.date_trunc("hour", "ts").alias("hr")).agg(F.avg("value").alias("speed"), F.count("*").alias("n"))


def epoch(c: Column | str) -> Column:
    """Seconds of a (zone-less) timestamp."""
    return F.unix_timestamp(F.col(c) if isinstance(c, str) else c)


def hours_of_span(sensor: DataFrame) -> DataFrame:
    """The spine: every hour from the first to the last seen."""
    return sensor.agg(F.min("hr").alias("lo"), F.max("hr").alias("hi")).select(F.explode(F.expr("sequence(lo, hi, interval 1 hour)")).alias("hr"))


def coverage_by_segment(sensor: DataFrame) -> DataFrame:
    span = sensor.agg(F.min(epoch("hr")).alias("lo"), F.max(epoch("hr")).alias("hi")).select(((F.col("hi") - F.col("lo")) / HOUR_S + 1).cast("long").alias("expected"))
    return sensor.groupBy("seg").agg(F.count("*").alias("observed")).join(F.broadcast(span)).select("seg", "observed", "expected", (100.0 * F.col("observed") / F.col("expected")).alias("coverage_pct"))


def coverage_by(sensor: DataFrame, part, name: str) -> DataFrame:
    """Coverage by a function of the hour: observed cells of segments x (hours of that part)."""
    spine = hours_of_span(sensor).groupBy(part(F.col("hr")).alias(name)).agg(F.count("*").alias("slots"))
    segs = sensor.agg(F.count_distinct("seg").alias("segs"))
    seen = sensor.groupBy(part(F.col("hr")).alias(name)).agg(F.count("*").alias("observed"), F.avg("speed").alias("mean_speed"))
    return spine.join(seen, name, "left").join(F.broadcast(segs)).select(name, F.coalesce("observed", F.lit(0)).cast("long").alias("observed"), (F.col("slots") * F.col("segs")).alias("expected"), (100.0 * F.coalesce("observed", F.lit(0)) / (F.col("slots") * F.col("segs"))).alias("coverage_pct"), "mean_speed")


def column_inventory(df: DataFrame) -> DataFrame:
    """Per column: its type, nulls, distinct values, rows; one pass, unpivoted."""
    cols, kinds = df.columns, dict(df.dtypes)
    one = df.agg(F.count("*").alias("_rows"), *(F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in cols), *(F.count_distinct(c).alias(f"d_{c}") for c in cols))
    items = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("data_type"), F.col(f"n_{c}").alias("n_null"), F.col(f"d_{c}").alias("n_distinct"), F.col("_rows").alias("n_rows")) for c in cols))
    return one.select(F.inline(items))


QUANTILES = (0.01, 0.05, 0.25, 0.75, 0.95, 0.99, 0.999)


def profile_aggregates(value: str) -> list[Column]:
    return [F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std_samp"), F.stddev_pop(value).alias("std_pop"), (100.0 * F.count_if(F.col(value) == 0) / F.count(value)).alias("zeros_pct")]


SHARES = {"median": 0.5} | {f"p{str(q)[2:]}": q for q in QUANTILES}


def profile(df: DataFrame, value: str) -> DataFrame:
    """Exact distribution in one row."""
    return ranks.with_quantiles(df.agg(*profile_aggregates(value)), df, value, SHARES)


def profile_by(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The same for each key alone and overall; `slice` and `key` name the group."""
    groups = [F.struct(F.lit("all").alias("slice"), F.lit("all").alias("key")), *(F.struct(F.lit(k).alias("slice"), F.col(k).cast("string").alias("key")) for k in keys)]
    long = df.select(F.explode(F.array(*groups)).alias("_g"), value).select("_g.slice", "_g.key", value)
    out = long.groupBy("slice", "key").agg(*profile_aggregates(value))
    return ranks.with_quantiles(out, long, value, SHARES, ["slice", "key"])


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of groups with more than one row."""
    return df.withColumn("copies", F.count("*").over(Window.partitionBy(*keys))).where("copies > 1")


def ratios(sensor: DataFrame) -> DataFrame:
    """Adds free flow (the segment's 95th percentile) and the ratio to it."""
    free = ranks.quantiles(sensor, "speed", {"free_flow": 0.95}, ["seg"])
    return sensor.join(free, "seg").withColumn("ratio", F.try_divide("speed", "free_flow"))


def ratio_counts(rated: DataFrame) -> DataFrame:
    r = F.col("ratio")
    return rated.agg(F.count("ratio").alias("n"), *(F.count_if(r < x).alias(f"below_{int(x * 100)}") for x in (0.9, 0.8, 0.7, 0.5)), F.count_if(F.abs(r - 1) <= 1e-9).alias("equal_1"), F.count_if(r > 1 + 1e-9).alias("above_1"))


def segment_quality(rated: DataFrame) -> DataFrame:
    return rated.groupBy("seg").agg(F.avg("speed").alias("mean_speed"), F.stddev_samp("speed").alias("std_speed"), F.min("speed").alias("min_speed"), F.max("speed").alias("max_speed"), F.avg("ratio").alias("mean_ratio"), (100.0 * F.count_if(F.col("ratio") < 0.8) / F.count("*")).alias("congested_pct"), F.count("*").alias("n"))


def segment_classes(quality: DataFrame) -> DataFrame:
    return quality.agg(F.count("*").alias("segments"), F.count_if(F.coalesce("std_speed", F.lit(0.0)) <= 0.1).alias("near_constant"), F.count_if(F.col("congested_pct") == 0).alias("never_congested"), F.count_if(F.col("congested_pct") > 50).alias("mostly_congested"))


def stability(df: DataFrame, key: str, value: str) -> DataFrame:
    """count, distinct, min, max, std per key; stable if there is one value at most."""
    return df.groupBy(key).agg(F.count(value).alias("n"), F.count_distinct(value).alias("n_distinct"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.stddev_samp(value).alias("std_value")).withColumn("stable", F.col("n_distinct") <= 1)


def grid_invariants(sensor: DataFrame) -> DataFrame:
    one = sensor.agg(F.count("*").alias("n"), F.count_distinct("seg").alias("segments"), F.count_distinct("hr").alias("hours"), F.count_distinct("seg", "hr").alias("pairs"), F.count_if(F.col("speed").isNull()).alias("null_speeds"))
    return one.withColumn("unique_cells", F.col("n") == F.col("pairs")).withColumn("complete", (F.col("n") == F.col("segments") * F.col("hours")) & (F.col("n") == F.col("pairs")))


def runs(df: DataFrame, key: str, slot: Column) -> DataFrame:
    """Gaps and islands: runs of consecutive integer slots per key: key, run, first, last, length, gap (slots missing before)."""
    w = Window.partitionBy(key).orderBy("_s")
    d = df.select(key, slot.cast("long").alias("_s")).distinct().withColumn("_p", F.lag("_s").over(w))
    d = d.withColumn("_new", F.when(F.col("_p").isNull() | (F.col("_s") - F.col("_p") > 1), 1).otherwise(0)).withColumn("run", F.sum("_new").over(w))
    return d.groupBy(key, "run").agg(F.min("_s").alias("first_slot"), F.max("_s").alias("last_slot"), F.count("*").alias("length"), F.max(F.when(F.col("_new") == 1, F.col("_s") - F.col("_p") - 1)).alias("gap"))


def run_summary(islands: DataFrame, key: str) -> DataFrame:
    out = islands.groupBy(key).agg(F.count("*").alias("n_runs"), F.max("length").alias("longest"), F.count_if(F.col("gap") == 1).alias("gaps_1"), F.count_if(F.col("gap") >= 2).alias("gaps_2_plus"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap"))
    return ranks.with_quantiles(out, islands, "length", {"median_length": 0.5}, [key]).select(key, "n_runs", "longest", "median_length", "gaps_1", "gaps_2_plus", "max_gap")


def cadence(sensor: DataFrame) -> DataFrame:
    """Steps between a segment's successive hours, in hours, and how often each occurs."""
    w = Window.partitionBy("seg").orderBy("hr")
    return sensor.withColumn("step_h", ((epoch("hr") - epoch(F.lag("hr").over(w))) / HOUR_S).cast("long")).where("step_h is not null").groupBy("step_h").agg(F.count("*").alias("n"))


def lag_correlation(sensor: DataFrame, lags: list[int], least: int = 3, key: str = "seg") -> DataFrame:
    """Correlation of rows with those `lag` rows on, only where exactly `lag` hours lie between; null under `least` pairs or without spread."""
    w = Window.partitionBy(key).orderBy("hr")
    out = None
    for k in lags:
        d = sensor.select(key, "speed", F.lit(k).alias("lag"), F.lead("speed", k).over(w).alias("_v"), ((epoch(F.lead("hr", k).over(w)) - epoch("hr")) / HOUR_S).alias("_d")).where(f"_d = {k}")
        out = d if out is None else out.unionByName(d)
    n, x, y = F.count("*"), F.col("speed"), F.col("_v")
    good = (n >= least) & (F.stddev_pop(x) > 1e-9) & (F.stddev_pop(y) > 1e-9)
    return out.groupBy(key, "lag").agg(n.alias("pairs"), F.when(good, K.correlation(x, y)).alias("acf"))


def pooled(acf: DataFrame) -> DataFrame:
    """Mean of the correlations, weighted by pairs."""
    ok = acf.where("acf is not null")
    return ok.groupBy("lag").agg(F.sum("pairs").alias("pairs"), F.try_divide(F.sum(F.col("acf") * F.col("pairs")), F.sum("pairs")).alias("acf"))


def spikes(sensor: DataFrame, times: float = 10.0, share: float = 0.99) -> DataFrame:
    """Values above a global percentile and `times` the hour before, which is there, positive and of the same day."""
    edge = ranks.quantiles(sensor, "speed", {"edge": share})
    w = Window.partitionBy("seg", F.to_date("hr")).orderBy("hr")
    d = sensor.select("seg", "hr", "speed", F.lag("speed").over(w).alias("before"), (epoch("hr") - epoch(F.lag("hr").over(w))).alias("_d"))
    return d.join(F.broadcast(edge)).where(f"_d = {HOUR_S} and before > 0 and speed > edge and speed >= {times} * before and hour(hr) != 0").select("seg", "hr", "speed", "before")


def formula_check(df: DataFrame, reported: Column, length_m: Column, speed_kmh: Column) -> DataFrame:
    """Adds expected seconds 3.6 * length / speed and the distance of the reported ones from it."""
    return df.withColumn("expected_s", F.try_divide(3.6 * length_m, speed_kmh)).withColumn("error_s", F.abs(reported - F.col("expected_s")))


def formula_summary(checked: DataFrame) -> DataFrame:
    e = F.col("error_s")
    out = checked.agg(F.count(e).alias("n"), F.avg(e).alias("mean_error"), F.max(e).alias("max_error"), F.count_if(e <= 1).alias("within_1"), F.count_if(e <= 5).alias("within_5"), F.count_if(e <= 0.1 * F.greatest(F.abs("expected_s"), F.lit(1.0))).alias("within_10pct"))
    return ranks.with_quantiles(out, checked, "error_s", {"median_error": 0.5}).select("n", "mean_error", "median_error", "max_error", "within_1", "within_5", "within_10pct")


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    b = F.least(F.greatest(F.floor((F.col(value) - lo) / ((hi - lo) / bins)), F.lit(0)), F.lit(bins - 1)).cast("long")
    return df.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))


def linear_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.count("*").alias("n"))


def window_means(sensor: DataFrame) -> DataFrame:
    """Means of hourly means in the morning (07-09) and evening (16-19), and of daily means on weekdays and weekends."""
    by_hour = sensor.groupBy(F.hour("hr").alias("h")).agg(F.avg("speed").alias("m"))
    by_day = sensor.groupBy(F.to_date("hr").alias("d")).agg(F.avg("speed").alias("m")).withColumn("w", F.weekday("d") >= 5)
    a = by_hour.select(F.when(F.col("h").between(7, 9), "morning").when(F.col("h").between(16, 19), "evening").alias("part"), "m").where("part is not null")
    b = by_day.select(F.when(F.col("w"), "weekend").otherwise("weekday").alias("part"), "m")
    return a.unionByName(b).groupBy("part").agg(F.avg("m").alias("mean_speed"), F.count("*").alias("n"))


def daily_accounting(sensor: DataFrame) -> DataFrame:
    segs = sensor.agg(F.count_distinct("seg").alias("_segs"))
    day = sensor.groupBy(F.to_date("hr").alias("day")).agg(F.count("*").alias("present"), F.sum("n").alias("readings"), F.count_if(F.col("n") > 1).alias("multiple"), F.sum("speed").alias("speed_sum"))
    return day.join(F.broadcast(segs)).select("day", (F.col("_segs") * 24).alias("expected"), "present", (F.col("_segs") * 24 - F.col("present")).alias("missing"), "readings", "multiple", "speed_sum")


def cardinality(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mapping checks: keys of each side with several partners."""
    one = df.groupBy(a).agg(F.count_distinct(b).alias("k")).agg(F.count("*").alias("left_keys"), F.count_if(F.col("k") > 1).alias("left_with_many"), F.max("k").alias("left_most"))
    two = df.groupBy(b).agg(F.count_distinct(a).alias("k")).agg(F.count("*").alias("right_keys"), F.count_if(F.col("k") > 1).alias("right_with_many"), F.max("k").alias("right_most"))
    return one.join(F.broadcast(two))


def missing_slots(sensor: DataFrame) -> DataFrame:
    """Per segment: hours seen, the usual step (the least of the most frequent), and slots of that step that are missing."""
    w = Window.partitionBy("seg").orderBy("hr")
    d = sensor.withColumn("_step", ((epoch("hr") - epoch(F.lag("hr").over(w))) / HOUR_S).cast("long"))
    one = d.groupBy("seg").agg(F.count("*").alias("n"), F.mode("_step", True).alias("step_h"), ((F.max(epoch("hr")) - F.min(epoch("hr"))) / HOUR_S).alias("_span"))
    return one.select("seg", "n", "step_h", (F.round(F.col("_span") / F.col("step_h")) + 1 - F.col("n")).cast("long").alias("missing"))


def running_stats(df: DataFrame, key: str, value: str, kind: str) -> DataFrame:
    """Per key: count, sum, sum of squares, zeros, extremes; the kinds seen, and the usual one (the least of the most frequent)."""
    v = F.col(value)
    kinds = F.array_join(F.array_sort(F.collect_set(kind)), ",")
    return df.groupBy(key).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.sum(v * v).alias("squares"), F.count_if(v == 0).alias("zeros"), F.min(value).alias("least"), F.max(value).alias("most"), kinds.alias("kinds"), F.mode(kind, True).alias("usual"))


def coverage_by_class(sensor: DataFrame, name: str) -> DataFrame:
    """Observed cells of each class of segments against its segments times all hours."""
    slots = sensor.agg(((F.max(epoch("hr")) - F.min(epoch("hr"))) / HOUR_S + 1).cast("long").alias("_slots"))
    one = sensor.groupBy(name).agg(F.count("*").alias("observed"), F.count_distinct("seg").alias("_segs")).join(F.broadcast(slots))
    expected = F.col("_segs") * F.col("_slots")
    return one.select(name, "observed", expected.alias("expected"), (100.0 * F.col("observed") / expected).alias("coverage_pct"))


def filled(counts: DataFrame, key: str, hour: str, value: str) -> DataFrame:
    """Every hour from the first to the last for each key, 0 where there is no row. For keys that are few: the grid has a row for each of their hours."""
    span = counts.agg(F.min(hour).alias("_lo"), F.max(hour).alias("_hi"))
    spine = counts.select(key).distinct().join(F.broadcast(span)).select(key, F.explode(F.expr("sequence(_lo, _hi, interval 1 hour)")).alias(hour))
    return spine.join(counts, [key, hour], "left").select(key, hour, F.coalesce(value, F.lit(0)).alias(value))


def coordinate_checks(df: DataFrame, lat: str, lon: str) -> DataFrame:
    y, x = F.col(lat), F.col(lon)
    odd = lambda test: F.count_if(test(y) | test(x))
    return df.agg(F.count("*").alias("n"), F.count_if(y.between(-90, 90) & x.between(-180, 180)).alias("in_bounds"), F.count_if(y > 0).alias("positive"), odd(lambda c: F.abs(c) == float("inf")).alias("infinite"), odd(F.isnan).alias("nan"))
