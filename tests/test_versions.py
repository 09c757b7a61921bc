"""Plans under weights that change: toy networks with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from sparkway.operators import versions as V

# From A to D by B in 20 + 20 + 20 (over E), or by C: 35 + 35. B to D directly is 60.
FIRST = [("A", "B", 20.0), ("B", "E", 20.0), ("E", "D", 20.0), ("A", "C", 35.0), ("C", "D", 35.0), ("B", "D", 60.0), ("E", "C", 10.0)]
PLAN = [("A", "B", 0), ("B", "E", 0), ("E", "D", 0)]


def run(spark, later, plans=(("p", 0.0, PLAN),), least_s=10.0, least_pct=3.0):
    changes = spark.createDataFrame([(u, v, 0, -1.0, w) for u, v, w in FIRST] + [(u, v, 0, t, w) for t, u, v, w in later], "u string, v string, key int, valid_from double, weight double")
    rows = spark.createDataFrame([(i, "A", "D", d, p) for i, d, p in plans], "id string, source string, target string, depart_s double, edge_path array<struct<u:string,v:string,key:int>>")
    done, log = V.rejudge(rows, changes, least_s, least_pct)
    return {r.id: ([e.u for e in r.edge_path] + [r.edge_path[-1].v] if r.edge_path else [], r.travel_s, r.n_versions, r.n_rerouted) for r in done.collect()}, sorted(((r.id, r.t, r["at"], r.remaining_s, r.best_s, r.triggered) for r in log.collect()), key=str)


def test_nothing_changes(spark):
    assert run(spark, []) == ({"p": (["A", "B", "E", "D"], 60.0, 0, 0)}, [])


def test_a_version_that_hurts_the_rest_turns_the_plan(spark):
    """At 30 the plan is between B and E, so it stands at E, at 40: E to D now takes 100, by C 45."""
    got, log = run(spark, [(30.0, "E", "D", 100.0)])
    assert got == {"p": (["A", "B", "E", "C", "D"], 85.0, 1, 1)}
    assert log == [("p", 30.0, "E", 100.0, 45.0, True)]


def test_a_version_that_helps_another_way_turns_the_plan(spark):
    got, log = run(spark, [(10.0, "B", "D", 5.0)])
    assert got == {"p": (["A", "B", "D"], 25.0, 1, 1)} and log == [("p", 10.0, "B", 40.0, 5.0, True)]


def test_too_little_to_gain(spark):
    """The rest takes longer, but the other way saves under ten seconds: kept, and timed anew."""
    got, log = run(spark, [(30.0, "E", "D", 54.0)])
    assert got == {"p": (["A", "B", "E", "D"], 94.0, 1, 0)} and log == [("p", 30.0, "E", 54.0, 45.0, False)]
    got, log = run(spark, [(30.0, "E", "D", 54.0)], least_s=9.0, least_pct=20.0)
    assert got["p"][3] == 0
    assert run(spark, [(30.0, "E", "D", 54.0)], least_s=9.0, least_pct=16.0)[0]["p"][3] == 1


def test_a_version_on_the_last_leg_comes_too_late(spark):
    got, log = run(spark, [(50.0, "E", "D", 500.0)])
    assert got == {"p": (["A", "B", "E", "D"], 60.0, 1, 0)} and log == [("p", 50.0, None, None, None, False)]


def test_versions_at_departure_and_at_arrival(spark):
    """In force from departure on; at arrival never met."""
    got, log = run(spark, [(0.0, "A", "B", 30.0), (70.0, "E", "D", 1.0)])
    assert got == {"p": (["A", "B", "E", "D"], 70.0, 0, 0)} and log == []


def test_a_version_that_comes_twice(spark):
    """First the way over E is slow, so the plan goes by C; then C is blocked as well, and the plan can only go on."""
    got, log = run(spark, [(10.0, "B", "E", 100.0), (10.0, "B", "D", 30.0), (15.0, "B", "D", 90.0), (15.0, "B", "E", 20.0)])
    assert log == [("p", 10.0, "B", 120.0, 30.0, True), ("p", 15.0, "B", 90.0, 40.0, True)]
    assert got == {"p": (["A", "B", "E", "D"], 60.0, 2, 2)}


def test_many_plans_at_once(spark):
    """Each meets what comes on its own way; those without edges stay."""
    plans = (("a", 0.0, PLAN), ("b", 25.0, PLAN), ("c", 100.0, PLAN), ("d", 0.0, []))
    got, log = run(spark, [(30.0, "E", "D", 100.0)], plans)
    assert got["a"] == (["A", "B", "E", "C", "D"], 85.0, 1, 1)
    # b reaches B at 45: by E and C it is 65, directly 60.
    assert got["b"] == (["A", "B", "D"], 80.0, 1, 1)
    assert got["c"] == (["A", "B", "E", "D"], 140.0, 0, 0) and got["d"] == ([], 0.0, 0, 0)
    assert [(x[0], x[2]) for x in log] == [("a", "E"), ("b", "B")]


def test_edges_without_weights(spark):
    """Null weights count ten seconds on a plan, and are not offered by searches."""
    got, log = run(spark, [(30.0, "E", "D", None)])
    assert got == {"p": (["A", "B", "E", "D"], 50.0, 1, 0)} and log == [("p", 30.0, "E", 10.0, 45.0, False)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id string, source string, target string, depart_s double, edge_path array<struct<u:string,v:string,key:int>>")
    changes = spark.createDataFrame([(u, v, 0, -1.0, w) for u, v, w in FIRST], "u string, v string, key int, valid_from double, weight double")
    done, log = V.rejudge(none, changes, 10.0, 3.0)
    assert done.count() == log.count() == 0


def test_as_of_join(spark):
    changes = spark.createDataFrame([("A", "B", 0, 0.0, 1.0), ("A", "B", 0, 10.0, 2.0), ("A", "B", 0, 10.0, 3.0), ("A", "B", 0, 20.0, None)], "u string, v string, key int, valid_from double, weight double")
    at = spark.createDataFrame([("A", "B", 0, float(t)) for t in (-5, 0, 9, 10, 19, 20, 99)], "u string, v string, key int, t double")
    got = {r.t: r.weight for r in V.in_force(at, V.periods(changes), "t").collect()}
    assert got == {-5.0: V.MISSING_S, 0.0: 1.0, 9.0: 1.0, 10.0: 3.0, 19.0: 3.0, 20.0: V.MISSING_S, 99.0: V.MISSING_S}


@pytest.mark.parametrize("width", [0.5, 7.0, 1e6])
def test_snapshots_in_buckets_of_any_width(spark, width):
    changes = spark.createDataFrame([("A", "B", 0, float(t), t + 1.0) for t in (0, 3, 7, 20)] + [("B", "C", 0, 5.0, 9.0)], "u string, v string, key int, valid_from double, weight double")
    times = spark.createDataFrame([(float(t),) for t in (1, 3, 6, 19, 25)], "t double")
    got = {(r.scenario, r.u): r.weight for r in V.snapshots(V.periods(changes), times, width).collect()}
    assert got == {("1.0", "A"): 1.0, ("3.0", "A"): 4.0, ("6.0", "A"): 4.0, ("6.0", "B"): 9.0, ("19.0", "A"): 8.0, ("19.0", "B"): 9.0, ("25.0", "A"): 21.0, ("25.0", "B"): 9.0}
    assert V.snapshots(V.periods(changes), times.where(F.lit(False)), width).count() == 0
