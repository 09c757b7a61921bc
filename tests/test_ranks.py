"""Order, ranks and quantiles over ranges, against sorting in one place."""

import random

import pytest
from pyspark.sql import functions as F

from sparkway.operators import features as X
from sparkway.operators import ranks as R

SCHEMA = "g string, x double"


def values(n, seed, distinct=40):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(distinct)), 7.0, rng.gauss(0, 3)])) for _ in range(n)]


def quantile(xs, q):
    xs = sorted(xs)
    at = q * (len(xs) - 1)
    lo = int(at)
    hi = min(lo + 1, len(xs) - 1)
    return xs[lo] + (at - lo) * (xs[hi] - xs[lo])


@pytest.mark.parametrize("n,partitions", [(1, 1), (50, 4), (700, 8)])
def test_quantiles(spark, n, partitions):
    rows = values(n, n) + [("one", 3.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    shares = {"low": 0.0, "p10": 0.1, "mid": 0.5, "p95": 0.95, "top": 1.0}
    every = [x for _, x in rows if x is not None]
    got = R.quantiles(df, "x", shares).first()
    assert [got[k] for k in shares] == pytest.approx([quantile(every, q) for q in shares.values()])
    by = {r.g: [r[k] for k in shares] for r in R.quantiles(df, "x", shares, ["g"]).collect()}
    groups = {g: [x for h, x in rows if h == g and x is not None] for g, _ in rows}
    assert by == {g: pytest.approx([quantile(xs, q) for q in shares.values()]) for g, xs in groups.items() if xs}


def test_ranks_within_groups(spark):
    rows = values(300, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    for by in ([], ["g"]):
        got = {(r.g, r.x): r.r for r in R.average_rank(df, "x", "r", by).collect()}
        want = {}
        for g, x in rows:
            if x is not None:
                own = [y for h, y in rows if y is not None and (not by or h == g)]
                want[g, x] = sum(y < x for y in own) + (sum(y == x for y in own) + 1) / 2
        assert got == want


def test_a_value_that_a_third_of_all_rows_hold(spark):
    df = spark.range(3000).select(F.lit("a").alias("g"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") / 100).alias("x"))
    xs = [5.0 if i % 3 == 0 else i / 100 for i in range(3000)]
    assert R.quantiles(df, "x", {"q": 0.3}).first().q == pytest.approx(quantile(xs, 0.3))


def test_positions_and_running_sums(spark):
    df = spark.createDataFrame([(x,) for x in [5, 3, 3, 9, 1, None, 5]], "x int")
    assert {r.x: r.i for r in R.positions(df, ["x"], "i").collect()} == {None: 0, 1: 1, 3: 2, 5: 3, 9: 4}
    sums = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 5).alias("v")).repartition(6)
    assert {r.k: r.s for r in R.running_sum(sums, ["k"], "v", "s").collect()} == {k: sum(i % 5 for i in range(k + 1)) for k in range(100)}


def test_values_carried_over_ranges(spark):
    """Long stretches without a value reach over whole ranges."""
    rows = [(i, i if i in (40, 41, 260) else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(8)
    got = {r.k: (r.lo, r.hi) for r in R.carried(df, ["k"], "v").collect()}
    assert got == {k: (max((v for i, v in rows if v is not None and i <= k), default=None), min((v for i, v in rows if v is not None and i >= k), default=None)) for k, _ in rows}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert R.quantiles(none, "x", {"q": 0.5}).first().q is None and R.quantiles(none, "x", {"q": 0.5}, ["g"]).count() == 0
    assert R.average_rank(none, "x", "r", ["g"]).count() == R.positions(none, ["x"], "i").count() == R.carried(none, ["x"], "g").count() == 0
    assert X.codes(none, "g", "c").count() == X.chronological_split(none, "x", 3, 3).count() == 0


def test_codes_and_splits(spark):
    df = spark.createDataFrame([("b", 3.0), ("a", 1.0), (None, 2.0), ("b", 1.0), ("c", 4.0)], SCHEMA)
    assert {r.g: r.c for r in X.codes(df, "g", "c").collect()} == {None: -1, "a": 0, "b": 1, "c": 2}
    assert {(r.x, r.split) for r in X.chronological_split(df, "x", 2, 1).collect()} == {(1.0, "train"), (2.0, "train"), (3.0, "val"), (4.0, "test")}
    assert {(r.x, r.position) for r in X.at_positions(df, "x", [0, 3, 9]).collect()} == {(1.0, 0), (4.0, 3)}


def test_no_window_holds_all_rows(spark):
    """The only windows without partitions are over one row a range."""
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    plan = R.positions(df, ["x"], "i")._jdf.queryExecution().optimizedPlan().toString()
    single = [line for line in plan.split("\n") if "Window" in line and line.rstrip().endswith("_range#0 ASC NULLS FIRST]")]
    assert not [line for line in single if "x#" in line]
