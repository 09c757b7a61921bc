"""Odd inputs and larger tables of the fourth round's findings."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkway import scratch
from sparkway.operators import choice, csr
from sparkway.operators import routing as R
from sparkway.streaming import hourly


@pytest.mark.parametrize("many", [9, 40])
def test_ways_ahead_are_looked_through_in_tasks(spark, many):
    """As by joins, with loops, parallel edges, dead ends and nodes that are not in the graph; no way is written."""
    rng = np.random.default_rng(many)
    # No two weights are equal, so that no order is left open.
    pairs = [(a, b) for a, b in rng.integers(0, many, (4 * many, 2)).tolist()]
    rows = [(f"n{a}", f"n{b}", k, float(x)) for k, ((a, b), x) in enumerate(zip([*pairs, *pairs[:many]], rng.permutation(5 * many) + 1.0, strict=True))] + [("n0", "end", 900, 0.5)]
    w = spark.createDataFrame(rows, "u string, v string, key int, weight double").withColumn("speed", F.lit(30.0))
    nodes = spark.createDataFrame([(f"n{i}", 20 + i / 1000, 85.0 - i / 900) for i in range(1, many)] + [("far", 20.1, 85.2), ("end", None, 1.0)], "node string, lat double, lon double")
    ends = ["n1", "n5", "far", "nowhere", None, "end"]
    states = [(i, f"n{i % many}", None if i % 3 else f"n{i % 7}", ends[i % 6], seen) for i, seen in enumerate([[f"n{i % many}", f"n{i % 5}"] for i in range(60)] + [None, [], ["n1", None]])]
    st = spark.createDataFrame(states, "id int, at string, prev string, target string, seen array<string>")
    e = scratch.materialize(choice.onward(st, w))
    keys, looks = ["id", "v", "key"], [f"look_{k}" for k in (1, 2, 3, 5)]
    written = len(scratch._written)
    found = choice.lookahead(e, w, nodes).select(*keys, *looks)
    got = {tuple(r[:3]): tuple(r[3:]) for r in found.collect()}
    assert len(scratch._written) == written
    want = {tuple(r[:3]): pytest.approx(tuple(r[3:])) for r in choice.lookahead(e, w, nodes, limit=0).select(*keys, *looks).collect()}
    assert len(want) > 100 and got == want


def test_searches_end_by_the_first_way_known():
    """What a way through the ball costs bounds the search from the source: few nodes get a label."""
    rng = np.random.default_rng(3)
    n, m = 20_000, 200_000
    u, v, w = rng.integers(0, n, m), rng.integers(0, n, m), rng.uniform(1, 500, m)
    at = np.lexsort((np.arange(m), v, u))
    g = csr.Arrays(np.concatenate([[0], np.cumsum(np.bincount(u, minlength=n))]), v[at].astype(np.int32), np.arange(m)[at].astype(np.int32), w[at])
    back, width = csr.turned(g), csr.fine_width(g)
    labels = []
    for i, j in rng.integers(0, n, (30, 2)).tolist():
        cost, want = csr.between(g, back, i, j, width), csr.search(g, i)
        assert cost[j] == want[j]
        labels.append(np.isfinite(cost).sum())
    assert np.mean(labels) < 600


def test_reach_of_larger_graphs_writes_nothing(spark, monkeypatch):
    """No label of a source and node is written, however many sources there are."""
    monkeypatch.setattr(R, "MAX_EDGES", 0)
    w = spark.createDataFrame([("now", a, b, 0, c) for a, b, c in (("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 4.0), ("c", "d", 0.5))], "scenario string, u string, v string, key int, weight double")
    written = len(scratch._written)
    got = {r.source: (r.reached, r.farthest) for r in R.reach_summary(w, w.select("scenario", F.col("u").alias("source")).distinct()).collect()}
    assert got == {"a": (4, 3.5), "b": (4, 6.0), "c": (4, 5.0)} and len(scratch._written) == written


def test_sessions_know_their_timer():
    """Timers are not listed, and one that stays is not touched; a call makes one table."""
    calls, state = [], []

    class Handle:
        registerTimer = staticmethod(lambda at: calls.append(("new", at)))
        deleteTimer = staticmethod(lambda at: calls.append(("gone", at)))

        class Value:
            exists, get, clear = staticmethod(lambda: bool(state)), staticmethod(lambda: state[-1]), staticmethod(state.clear)
            update = staticmethod(state.append)

        getValueState = staticmethod(lambda name, kind: Handle.Value)

    s = hourly.Sessions(10.0)
    s.init(Handle)
    seen = []
    for times in ([None], [1.0, 5.0], [2.0], [7.0, 30.0, 31.0]):
        rows = pd.DataFrame({"kind": "POSITION", "node": "n", "elapsed_s": np.array(times, float)})
        seen.append([tuple(r) for out in s.handleInputRows(("v",), iter([rows]), None) for r in out[["first_s", "elapsed_s", "updates", "late", "ended"]].itertuples(index=False)])
    assert seen[1:] == [[(1.0, 5.0, 2, 0, False)], [(1.0, 5.0, 3, 1, False)], [(1.0, 7.0, 4, 1, True), (30.0, 31.0, 2, 0, False)]]
    assert calls == [("new", 15001), ("gone", 15001), ("new", 41001)]
