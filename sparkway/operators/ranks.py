"""Global order without a task that holds it all: positions, running sums, ranks, exact quantiles, and values carried along.

Rows are dealt into ranges of the order and written once, with the number of their
range. Windows run within a range; what stands before it is the sum of the ranges
before, one row a range, and joined back. Repeated keys are counted first, so that a key
which a third of all rows hold is one row.

Nulls are left out of ranks and quantiles and stand first in positions. Equal keys share
a position. Empty tables give no rows; a group without values has null quantiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import join_sized, materialize

RANGE = "_range"


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """`df` in ranges of the order, with the number of each row's range."""
    return materialize(df.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()))


def before(parts: DataFrame, sums: dict[str, str]) -> DataFrame:
    """For each range, sums over the ranges before it: name -> column of `parts`. One row a range."""
    w = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(RANGE).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    return totals.select(RANGE, *(F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sums))


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over all rows up to each, in an order without ties."""
    rows = ranged(df, order)
    w = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_own", F.sum(value).over(w))
    return own.join(F.broadcast(before(rows, {"_before": value})), RANGE).withColumn(name, F.col("_own") + F.col("_before")).drop(RANGE, "_own", "_before")


def positions(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The distinct values of the columns with their place in order, from 0."""
    one = df.select(*columns).distinct().withColumn("_one", F.lit(1).cast("long"))
    return running_sum(one, columns, "_one", name).withColumn(name, F.col(name) - 1).drop("_one")


def counted(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, value, _cnt (rows), _up (rows of the group up to the value) and _rows (rows of the group), for values that aren't null."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_cnt"))
    if not by:
        up = materialize(running_sum(counts, [value], "_cnt", "_up"))
        return up.join(F.broadcast(up.agg(F.max("_up").alias("_rows"))))
    # Along (group, value) the whole table has one running sum; a group begins where it was least.
    up = materialize(running_sum(counts, [*by, value], "_cnt", "_cum"))
    start = up.groupBy(*by).agg(F.min(F.col("_cum") - F.col("_cnt")).alias("_start"), F.sum("_cnt").alias("_rows"))
    named = start.select(*(F.col(c).alias(f"_g_{c}") for c in by), "_start", "_rows")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return up.join(named, same).withColumn("_up", F.col("_cum") - F.col("_start")).drop("_cum", "_start", *(f"_g_{c}" for c in by))


def average_rank(df: DataFrame, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Ranks from 1 within `by`, ties at their mean; rows without a value are dropped."""
    by = by or []
    ranks = counted(df, value, by).select(*(F.col(c).alias(f"_k_{c}") for c in (*by, value)), (F.col("_up") - (F.col("_cnt") - 1) / 2).alias(name))
    same = F.col(value) == F.col(f"_k_{value}")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return df.join(ranks, same).drop(*(f"_k_{c}" for c in (*by, value)))


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """by and, for each name, the exact quantile by linear interpolation: the rows that hold the ranks asked for are picked out of the running counts."""
    by = by or []
    rows = counted(df, value, by)
    # Ranks from 0 below and above each share's place.
    asked = F.array(*(F.struct(F.lit(n).alias("name"), (F.lit(float(s)) * (F.col("_rows") - 1)).alias("at")) for n, s in shares.items()))
    rank = lambda f: lambda x: (f(x["at"]) >= F.col("_up") - F.col("_cnt")) & (f(x["at"]) < F.col("_up"))
    side = lambda u: lambda x: F.struct(x["name"].alias("name"), x["at"].alias("at"), F.lit(u).alias("upper"))
    held = F.concat(*(F.transform(F.filter(asked, rank(f)), side(u)) for u, f in ((False, F.floor), (True, F.ceil))))
    met = rows.select(*by, F.col(value).cast("double").alias("_v"), F.explode(held).alias("_h"))
    of = lambda n, u: F.max(F.when((F.col("_h.name") == n) & (F.col("_h.upper") == F.lit(u)), F.col("_v")))
    at = lambda n: F.max(F.when(F.col("_h.name") == n, F.col("_h.at")))
    aggs = [c for n in shares for c in (of(n, False).alias(f"_lo_{n}"), of(n, True).alias(f"_hi_{n}"), at(n).alias(f"_at_{n}"))]
    found = met.groupBy(*by).agg(*aggs) if by else met.agg(*aggs)
    part = lambda n: F.col(f"_at_{n}") - F.floor(f"_at_{n}")
    return found.select(*by, *(((1 - part(n)) * F.col(f"_lo_{n}") + part(n) * F.col(f"_hi_{n}")).alias(n) for n in shares))


def with_quantiles(summary: DataFrame, df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """`summary` (a row a group of `by`) with the quantiles of each group of `df`."""
    q = quantiles(df, value, shares, by)
    if not by:
        return summary.join(F.broadcast(q))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_q_{c}"))
    return summary.join(q.withColumnsRenamed({c: f"_q_{c}" for c in by}), same, "left").drop(*(f"_q_{c}" for c in by))


def with_position(df: DataFrame, column: str, name: str) -> DataFrame:
    """`df` with the place of the column's value among its distinct values, from 0; nulls are dropped."""
    return join_sized(df, positions(df.where(F.col(column).isNotNull()), [column], name), [column], "inner")


def carried(df: DataFrame, order: list[str], known: str) -> DataFrame:
    """Adds lo and hi: the last `known` that isn't null up to each row, and the first from it on, in an order without ties."""
    rows = ranged(df, order)
    w = Window.partitionBy(RANGE).orderBy(*order)
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    own = rows.withColumns({"_lo": F.last(known, True).over(up), "_hi": F.first(known, True).over(down)})
    # The last known value of each range and the first: carried over the ranges, one row each.
    key = F.struct(*order)
    ends = rows.groupBy(RANGE).agg(F.max_by(known, F.when(F.col(known).isNotNull(), key)).alias("_last"), F.min_by(known, F.when(F.col(known).isNotNull(), key)).alias("_first"))
    across = Window.orderBy(RANGE)
    ends = ends.select(RANGE, F.last("_last", True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_past"), F.first("_first", True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_next"))
    return own.join(F.broadcast(ends), RANGE).withColumns({"lo": F.coalesce("_lo", "_past"), "hi": F.coalesce("_hi", "_next")}).drop(RANGE, "_lo", "_hi", "_past", "_next")
