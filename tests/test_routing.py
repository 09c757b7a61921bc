"""Toy graphs with known answers."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkway.functions import kinematics as K
from sparkway.operators import components as C
from sparkway.operators import choice
from sparkway.operators import evaluation as V
from sparkway.operators import routing as R
from sparkway.operators import walk as W
from sparkway.operators import weights as G

# From p to t: by q and r 1 + 2.5 + 3 = 6.5, by q alone 1 + 7 = 8, by r alone 4 + 3 = 7; nothing leaves t.
LADDER = [("p", "q", 0, 1.0), ("p", "r", 0, 4.0), ("q", "r", 0, 2.5), ("q", "t", 0, 7.0), ("r", "t", 0, 3.0)]
# Four ways on from k, the cheapest over m: 1.5 + 6 to z; over n it is 2 + 1.
FAN = [("k", "m", 0, 1.5), ("k", "n", 0, 2.0), ("k", "o", 0, 8.0), ("k", "o", 1, 9.0), ("m", "z", 0, 6.0), ("n", "z", 0, 1.0), ("o", "z", 0, 0.5)]
BYPASS = [("A", "B"), ("B", "C"), ("C", "D"), ("B", "E"), ("E", "D")]


def weights(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], "scenario string, u string, v string, key int, weight double")


def route(spark, rows, a, b, **kw):
    ask = spark.createDataFrame([("s", a, b)], "scenario string, source string, target string")
    return R.routes(ask, weights(spark, rows), **kw).first()


def test_ladder(spark):
    r = route(spark, LADDER, "p", "t")
    assert r["node_path"] == ["p", "q", "r", "t"] and r["cost"] == 6.5 and r["is_reached"] and r["visited"] == 4


def test_same_node_and_unreachable(spark):
    r = route(spark, [("A", "B", 0, 10.0)], "A", "A")
    assert (r["node_path"], r["edge_path"], r["cost"], r["visited"]) == (["A"], [], 0.0, 1)
    r = route(spark, [("A", "B", 0, 5.0), ("C", "D", 0, 5.0)], "A", "D")
    assert not r["is_reached"] and r["cost"] is None and r["node_path"] == [] and r["visited"] == 2


def test_parallel_edges(spark):
    r = route(spark, [("A", "B", 0, 10.0), ("A", "B", 1, 3.0)], "A", "B")
    assert r["edge_path"][0]["key"] == 1 and r["cost"] == 3.0


def lattice(n, seed):
    """A grid with random costs, some shortcuts and nodes that nothing leads to; coordinates."""
    rng = random.Random(seed)
    at = {f"{i:02d}.{j:02d}": (20 + 0.001 * i, 85 + 0.001 * j) for i in range(n) for j in range(n)}
    rows = [(f"{i:02d}.{j:02d}", f"{i + di:02d}.{j + dj:02d}", 0, rng.choice([1.0, 2.0, 2.5, 4.0]) * 10) for i in range(n) for j in range(n) for di, dj in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= i + di < n and 0 <= j + dj < n and rng.random() < 0.85]
    rows += [(*rng.sample(sorted(at), 2), 1, rng.uniform(20, 90)) for _ in range(n)] + [("lost", "00.00", 0, 1.0)]
    return rows, at


def heap(rows, a):
    """Costs from a, and nodes in the order in which they are settled."""
    out = {}
    for u, v, _, w in rows:
        out.setdefault(u, []).append((v, w))
    cost, order, queue = {}, [], [(0.0, a)]
    while queue:
        c, u = heapq.heappop(queue)
        if u not in cost:
            cost[u] = c
            order.append(u)
            for v, w in out.get(u, ()):
                heapq.heappush(queue, (c + w, v))
    return cost, order


@pytest.mark.parametrize("seed", [1])
def test_arrays_and_relaxation_agree_with_a_heap(spark, seed):
    """Both sides of the bound, guided or not: costs, visited and paths."""
    rows, at = lattice(7, seed)
    rng = random.Random(seed)
    pairs = [tuple(rng.choices([*at, "lost"], k=2)) for _ in range(25)] + [("00.00", "lost"), ("nowhere", "00.00"), ("00.00", "nowhere"), ("nowhere", "nowhere"), (None, "00.00"), ("00.00", None), ("03.03", "03.03")]
    ask = spark.createDataFrame([("s", i, *p) for i, p in enumerate(pairs * 2)], "scenario string, id int, source string, target string")
    w = weights(spark, rows)
    nodes = spark.createDataFrame([(n, *p) for n, p in at.items()], "node string, lat double, lon double")
    show = lambda df: {r.id: (r.cost, r.visited, r.is_reached, r.node_path, r.edge_path) for r in df.collect()}
    plain = show(R.routes(ask, w))
    assert plain == show(R.routes(ask, w, limit=0))
    for i, (a, b) in enumerate(pairs):
        cost, order = heap(rows, a) if a is not None else ({}, [])
        got = plain[i]
        assert got == plain[i + len(pairs)]
        assert got[0] == (pytest.approx(cost[b]) if b in cost else None) and got[2] == (b in cost)
        assert got[1] == (order.index(b) + 1 if b in cost else len(order))
    guided = show(R.routes(ask, w, nodes, guided=True))
    assert guided == show(R.routes(ask, w, nodes, guided=True, limit=0))
    assert [x[0] for x in guided.values()] == [x[0] for x in plain.values()] and sum(x[1] for x in guided.values()) < sum(x[1] for x in plain.values())


@pytest.mark.parametrize("width", [15.0, 1e9])
def test_buckets_of_any_width_settle_the_same(spark, width):
    rows, _ = lattice(5, 3)
    w = weights(spark, rows)
    sources = spark.createDataFrame([("s", "00.00"), ("s", "02.03"), ("s", None), ("s", "00.00")], "scenario string, source string")
    got = {(r.source, r.node): r.cost for r in R.relax(w, sources, width=width).collect()}
    assert got == {(a, n): pytest.approx(c) for a in ("00.00", "02.03") for n, c in heap(rows, a)[0].items()}


def test_trees_give_what_remains_and_the_first_edge(spark):
    w = weights(spark, LADDER)
    targets = spark.createDataFrame([("s", "t"), ("s", "r")], "scenario string, target string")
    for limit in (None, 0):
        got = {(r.target, r.node): (r.remaining_s, r.next_v, r.next_key) for r in R.trees(w, targets, limit).collect()}
        assert got == {("t", "p"): (6.5, "q", 0), ("t", "q"): (5.5, "r", 0), ("t", "r"): (3.0, "t", 0), ("t", "t"): (0.0, None, None), ("r", "p"): (3.5, "q", 0), ("r", "q"): (2.5, "r", 0), ("r", "r"): (0.0, None, None)}


def test_no_graph_at_all(spark):
    none = weights(spark, [])
    ask = spark.createDataFrame([("s", "A", "B"), ("s", "A", "A")], "scenario string, source string, target string")
    for limit in (None, 0):
        assert {(r.target, r.cost, r.visited) for r in R.routes(ask, none, limit=limit).collect()} == {("B", None, 1), ("A", 0.0, 1)}
    assert R.routes(ask.where("false"), weights(spark, LADDER)).count() == 0
    zero = weights(spark, [("A", "B", 0, 0.0), ("B", "C", 0, None), ("A", "C", 0, 5.0)])
    assert {(r.target, r.cost) for r in R.routes(spark.createDataFrame([("s", "A", "B"), ("s", "A", "C")], "scenario string, source string, target string"), zero).collect()} == {("B", R.LEAST), ("C", 5.0)}


def test_kinematics(spark):
    one = spark.range(1).select(K.travel_time(F.lit(1000.0), F.lit(36.0)), K.travel_time(F.lit(300.0), F.lit(0.0)), K.travel_time(F.lit(300.0), F.lit(-10.0)), K.class_speed(F.lit("['trunk_link']")), K.class_speed(F.lit("service"))).first()
    assert one[0] == pytest.approx(100.0) and one[1] == pytest.approx(360.0) and one[2] == pytest.approx(360.0) and one[3] == 50.0 and one[4] == 15.0


def test_relaxation_and_search_agree(spark):
    w = weights(spark, LADDER)
    best = {(r.source, r.node): r.cost for r in R.relax(w, w.select("scenario", F.col("u").alias("source")).distinct()).collect()}
    assert best["p", "t"] == 6.5 and best["p", "r"] == 3.5 and best["p", "p"] == 0.0 and ("t", "p") not in best
    ask = spark.createDataFrame([("s", "p", "t"), ("s", "t", "p"), ("s", "p", "p")], "scenario string, source string, target string")
    a = sorted((r.source, r.target, r.cost, r.node_path) for r in R.routes(ask, w).collect() if r.is_reached)
    b = sorted((r.source, r.target, r.cost, r.node_path) for r in R.by_relaxation(ask, w).collect() if r.is_reached)
    assert a == b and len(a) == 2


def test_congestion_moves_the_route(spark):
    free = [("A", "B", 0, 90.0), ("B", "D", 0, 90.0), ("A", "C", 0, 108.0), ("C", "D", 0, 108.0)]
    slow = [(u, v, k, 360.0 if w == 90.0 else w) for u, v, k, w in free]
    assert route(spark, free, "A", "D")["node_path"] == ["A", "B", "D"]
    assert route(spark, slow, "A", "D")["node_path"] == ["A", "C", "D"]


def test_planning_does_not_see_what_is_observed(spark):
    predicted = [("A", "B", 0, 50.0), ("B", "D", 0, 50.0), ("A", "C", 0, 100.0), ("C", "D", 0, 100.0)]
    actual = weights(spark, [("A", "B", 0, 500.0), ("B", "D", 0, 500.0), ("A", "C", 0, 100.0), ("C", "D", 0, 100.0)])
    ask = spark.createDataFrame([("s", 1, "A", "D")], "scenario string, od int, source string, target string")
    r = R.path_cost(R.routes(ask, weights(spark, predicted)), actual, ["od"], "actual").first()
    assert r.node_path == ["A", "B", "D"] and r.actual == 1000.0


def test_static_weights(spark):
    e = spark.createDataFrame([(u, v, 0, 1000.0 if i < 3 else 1100.0, "primary" if i < 3 else "secondary") for i, (u, v) in enumerate(BYPASS)], "u string, v string, key int, length_m double, highway string")
    w = {(r.u, r.v): r.static_weight for r in G.static_weights(e).collect()}
    assert w["A", "B"] == pytest.approx(90.0) and w["B", "E"] == pytest.approx(132.0)


@pytest.mark.parametrize("remaining,best,hit,saving,pct", [(100.0, 95.0, False, 5.0, 5.0), (200.0, 150.0, True, 50.0, 25.0)])
def test_gate(spark, remaining, best, hit, saving, pct):
    r = spark.range(1).select(*(c.alias(n) for n, c in R.gate(F.lit(remaining), F.lit(best), 10.0, 3.0).items())).first()
    assert (r.triggered, r.saving_s, r.saving_pct) == (hit, saving, pct)


def test_replay(spark):
    table = lambda ws: spark.createDataFrame([(u, v, 0, w) for (u, v), w in zip(BYPASS, ws, strict=True)], "u string, v string, key int, weight double")
    predicted, observed = table([90.0, 90.0, 90.0, 130.0, 130.0]), table([90.0, 90.0, 360.0, 130.0, 130.0])
    plan = R.routes(spark.createDataFrame([("p", 1, "A", "D")], "scenario string, od int, source string, target string"), predicted.withColumn("scenario", F.lit("p")))
    r = R.replay(plan.select("od", "source", "target", "edge_path"), predicted, observed, 0.33, 10.0, 3.0).first()
    assert (r.no_reroute_s, r.dynamic_s, r.triggered) == (540.0, 350.0, True)
    assert 100 * (r.no_reroute_s - r.dynamic_s) / r.no_reroute_s == pytest.approx(35.19, abs=0.01)


def states(spark, at, prev=None):
    return spark.createDataFrame([(1, at, prev, [at])], "id int, at string, prev string, visited array<string>")


def test_candidates(spark):
    w = weights(spark, FAN).withColumn("speed", F.lit(36.0))
    r = W.candidates(states(spark, "k"), w).collect()
    assert {x.v for x in r} == {"m", "n"} and r[0].n_out == 4 and r[0].n_eligible == 4
    assert [(x.v, x.kind) for x in W.candidates(states(spark, "o"), w).collect()] == [("z", "forced")]
    assert [x.kind for x in W.candidates(states(spark, "z"), w).collect()] == ["dead_end"]


def test_no_turning_back(spark):
    w = weights(spark, [("A", "B", 0, 10.0), ("B", "A", 0, 10.0), ("A", "C", 0, 10.0), ("B", "D", 0, 10.0), ("C", "D", 0, 10.0)]).withColumn("speed", F.lit(36.0))
    assert [(x.v, x.kind) for x in W.candidates(states(spark, "B", "A"), w).collect()] == [("D", "forced")]


def choose(spark, rows, at, target, nodes=None, prev=None, seen=None, speeds=None, **kw):
    """The picks from one state, by rule."""
    w = weights(spark, rows).withColumn("speed", F.lit(36.0))
    for (u, v), x in (speeds or {}).items():
        w = w.withColumn("speed", F.when((F.col("u") == u) & (F.col("v") == v), x).otherwise(F.col("speed")))
    known = [(n, *p) for n, p in (nodes or {}).items()]
    st = spark.createDataFrame([(1, at, prev, target, seen or [at])], "id int, at string, prev string, target string, seen array<string>")
    r = choice.choices(st, w, spark.createDataFrame(known, "node string, lat double, lon double"), **kw).first()
    return {c[5:]: (r[c].v, r[c].key, r[c].score) if r[c] else None for c in r.asDict() if c.startswith("pick_")} | {"n": r.n_onward, "slow": r.is_congested}


def test_rules_on_a_fan(spark):
    got = choose(spark, FAN, "k", "z")
    assert got["greedy"] == ("m", 0, 1.5) and got["look_1"] == ("m", 0, 1.5)
    assert got["look_2"] == got["look_3"] == got["look_5"] == ("n", 0, 3.0) and got["n"] == 4


def test_lookahead_goes_around_a_bottleneck(spark):
    rows = [("A", "B", 0, 1.0), ("B", "D", 0, 50.0), ("A", "C", 0, 3.0), ("C", "D", 0, 3.0)]
    got = choose(spark, rows, "A", "D")
    assert got["greedy"][0] == "B" and got["look_2"] == ("C", 0, 6.0) and got["adaptive"][0] == "B" and not got["slow"]
    slow = choose(spark, rows, "A", "D", speeds={("A", "B"): 10.0})
    assert slow["slow"] and slow["adaptive"] == ("C", 0, 6.0)


def test_destination_aware(spark):
    at = {"A": (20.0, 85.0), "B": (20.5, 85.0), "C": (20.001, 85.001), "D": (20.001, 85.002)}
    got = choose(spark, [("A", "B", 0, 2.0), ("A", "C", 0, 4.0), ("C", "D", 0, 1.0)], "A", "D", at)
    assert got["greedy"][0] == "B" and got["aware"][0] == "C" and got["look_1"][0] == "C"


def test_looking_past_seen_nodes(spark):
    """Nodes seen are left out before the cheapest four are taken; the leaf counts the rest of the way; dead ends cost most."""
    back = [("b", "a", k, 0.1 * (k + 1)) for k in range(4)]
    at = {"b": (20.0, 85.0), "c": (20.0, 85.0), "e": (20.001, 85.0)}
    rows = [("a", "b", 0, 1.0), *back, ("b", "c", 0, 5.0)]
    rest = 111.19492664 / (25 / 3.6)
    got = choose(spark, rows, "a", "e", at)
    assert got["look_2"][2] == pytest.approx(6.0 + rest, abs=1e-3) and got["look_3"][2] == pytest.approx(6.0 + choice.DEAD_END)
    assert choose(spark, rows[:5], "a", "e", at)["look_2"][2] == pytest.approx(1.0 + choice.NO_WAY_ON)


def test_nodes_seen_stand_behind(spark):
    rows = [("A", "B", 0, 1.0), ("A", "C", 0, 9.0), ("A", "D", 0, 10.0)]
    assert choose(spark, rows, "A", "Z", seen=["B", "A"])["greedy"] == ("C", 0, 9.0)
    assert choose(spark, rows[:1], "A", "Z", seen=["B", "A"])["greedy"] == ("B", 0, 1001.0)
    assert choose(spark, rows[:2], "A", "Z", prev="B")["greedy"] == ("C", 0, 9.0)
    assert choose(spark, rows[:1], "A", "Z", prev="B")["n"] == 1
    assert choose(spark, rows, "B", "Z") == {k: None for k in ("greedy", "aware", "look_1", "look_2", "look_3", "look_5", "adaptive")} | {"n": 0, "slow": False}


def test_pruning_changes_no_score(spark):
    """Against a plain recursion over every way."""
    rows, at = lattice(4, 5)
    out = {}
    for u, v, k, w in rows:
        out.setdefault(u, []).append((w, v, k))

    def ahead(a, b):
        (y, x), (q, p) = ((math.radians(c) for c in at[n]) for n in (a, b))
        s = math.sin((q - y) / 2) ** 2 + math.cos(y) * math.cos(q) * math.sin((p - x) / 2) ** 2
        return 2 * 6_371_000 * math.atan2(math.sqrt(s), math.sqrt(1 - s)) / (25 / 3.6)

    def look(node, target, depth, seen):
        if node == target:
            return 0.0
        if depth == 0:
            return ahead(node, target)
        if node not in out:
            return 1e6
        on = sorted(e for e in out[node] if e[1] not in seen)[:4]
        return min((w + look(v, target, depth - 1, seen | {v}) for w, v, _ in on), default=1e5)

    states = [(i, a, None, b, [a]) for i, (a, b) in enumerate((a, b) for a in list(at)[:6] for b in list(at)[-5:])]
    st = spark.createDataFrame(states, "id int, at string, prev string, target string, seen array<string>")
    w = weights(spark, rows).withColumn("speed", F.lit(30.0))
    nodes = spark.createDataFrame([(n, *p) for n, p in at.items()], "node string, lat double, lon double")
    got = {(r.id, r.v, r.key): [r[f"look_{k}"] for k in (1, 2, 3, 5)] for r in choice.lookahead(choice.onward(st, w), w, nodes).collect()}
    want = {(i, v, k): [pytest.approx(c + look(v, b, d - 1, {a, v})) for d in (1, 2, 3, 5)] for i, a, _, b, _ in states for c, v, k in out.get(a, ())}
    assert got == want


def test_rules_of_the_callers_own(spark):
    """A rule is a function that gives a column."""
    got = choose(spark, FAN, "k", "z", rules={"dearest": lambda: -F.col("weight")})
    assert got["dearest"] == ("o", 1, -9.0)


def test_lookahead_as_joins(spark):
    w = weights(spark, FAN).drop("scenario")
    nodes = spark.createDataFrame([(n, 20.0, 85.0) for n in "kmnoz"], "node string, lat double, lon double")
    e = w.where("u = 'k'").select(F.lit(1).alias("id"), F.col("u").alias("at"), F.lit("z").alias("target"), "v", "key", "weight")
    got = {(r.v, r.key): r.look_s for r in W.lookahead_two(e, w, nodes).collect()}
    assert got == {("m", 0): 7.5, ("n", 0): 3.0, ("o", 0): 8.5, ("o", 1): 9.5}


def test_greedy_walks_to_their_bound(spark):
    w = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", 0, 1.0) for i in range(30)] + [("x", "y", 0, 1.0), ("y", "x", 0, 1.0)], "u string, v string, key int, weight double")
    ask = spark.createDataFrame([(1, "n00", "n30", 50), (2, "n00", "n30", 7), (3, "x", "n30", 9), (4, "n30", "n00", 50), (5, "x", "x", 50)], "id int, source string, target string, max_hops int")
    got = {r.id: (r.hops, r.arrived, r.cost) for r in W.greedy_walk(ask, w).collect()}
    assert got == {1: (30, True, 30.0), 2: (7, False, 7.0), 3: (9, False, 9.0), 4: (0, False, 0.0), 5: (0, True, 0.0)}


def test_guide_speed_keeps_costs_least(spark):
    at = {"a": (20.0, 85.0), "b": (20.01, 85.0), "c": (20.02, 85.0), "d": (20.0, 85.02)}
    edges = [("a", "b", 0, 100.0), ("b", "c", 0, 100.0), ("a", "d", 0, 150.0), ("d", "c", 0, 10.0)]
    nodes = spark.createDataFrame([(n, *p) for n, p in at.items()], "node string, lat double, lon double")
    assert route(spark, edges, "a", "c", nodes=nodes, guided=True)["cost"] == route(spark, edges, "a", "c")["cost"] == 160.0


def test_timeline_defaults(spark):
    w = spark.createDataFrame([("A", "B", 0, 50.0, 500.0), ("B", "C", 0, 50.0, 500.0), ("F", "E", 0, 40.0, 400.0)], "u string, v string, key int, weight double, length_m double")
    path = [("A", "B", 0), ("B", "C", 0), ("C", "F", 0), ("F", "E", 0)]
    t = W.timeline(spark.createDataFrame([(1, path)], f"od int, edge_path {R.EDGE_PATH}"), w, ["od"]).orderBy("step").collect()
    assert [r.elapsed_s for r in t] == [50.0, 100.0, 110.0, 150.0] and t[-1].node == "E" and t[-1].progress_pct == 100.0


def test_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "f")], "u string, v string")
    weak = {r.node: r.component for r in C.weak(e).collect()}
    assert weak == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e"}
    strong = C.strong(e).collect()
    groups = {}
    for r in strong:
        groups.setdefault(r.component, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [["a", "b", "c"], ["d"], ["e"], ["f"]]


def test_jaccard_of_nothing(spark):
    r = spark.sql("select array() as a, array() as b, array(1, 2) as c, array(2, 3) as d").select(R.jaccard("a", "b"), R.jaccard("c", "d")).first()
    assert r[0] == 1.0 and r[1] == pytest.approx(1 / 3)


def test_stricter_policies_reroute_no_more(spark):
    facts = spark.createDataFrame([(float(i), float(i) / 2, 100.0) for i in range(40)], "saving_s double, saving_pct double, no_reroute_s double")
    r = {(x.min_s, x.min_pct): x.reroutes for x in V.policy_summary(facts, V.grid(spark, [0, 10, 30], [0, 5, 10])).collect()}
    assert all(r[a, b] >= r[c, d] for a, b in r for c, d in r if c >= a and d >= b)
