"""Odd inputs and larger tables of the third round's findings."""

import datetime as dt
import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkway.functions import tails as P
from sparkway.operators import audit as A
from sparkway.operators import csr
from sparkway.operators import matching as M
from sparkway.operators import routing as R
from sparkway.operators import spatial as S2
from sparkway.plans import inventory_queries
from sparkway.sources import readers as IO
from sparkway.streaming import hourly as S


def test_correlation_of_constant_segments(spark):
    rows = [(1, dt.datetime(2024, 1, 1, h), 5.0) for h in range(8)] + [(2, dt.datetime(2024, 1, 1, h), float(h)) for h in range(8)]
    got = A.lag_correlation(spark.createDataFrame(rows, "seg long, hr timestamp_ntz, speed double"), [1])
    assert {r.seg: r.acf for r in got.collect()} == {1: None, 2: pytest.approx(1.0)}


def test_signed_ranks_of_many_rows(spark):
    n = 9_000_000
    d = spark.createDataFrame([(n, n * (n + 1) / 4, 0)], "n long, w double, ties long")
    assert d.select(P.signed_rank_p(F.col("n"), F.col("w"), F.col("ties")).alias("p")).first().p == pytest.approx(1.0)


@pytest.mark.parametrize("least", [1, 7])
def test_searches_from_both_ends(least):
    """Costs and ways as by the search from one end, with many ties, loops and parallel edges."""
    rng = np.random.default_rng(least)
    for n, m in ((5, 8), (40, 120), (400, 3000)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        w, key = rng.integers(least, least + 6, m) / 3, np.arange(m)
        at = np.lexsort((key, v, u))
        g = csr.Arrays(np.concatenate([[0], np.cumsum(np.bincount(u, minlength=n))]), v[at].astype(np.int32), key[at].astype(np.int32), w[at])
        back, width = csr.turned(g), csr.fine_width(g)
        for i, j in rng.integers(0, n, (60, 2)).tolist():
            want = csr.search(g, i)
            got = csr.between(g, back, i, j, width)
            assert got[j] == want[j]
            if np.isfinite(want[j]):
                assert csr.way(g, back, got, i, j).tolist() == csr.path(g, csr.predecessors(g, want, i), i, j).tolist()


def test_point_searches_of_many_scenarios(spark):
    """Each scenario is sent on its own where all are too large together; all ways give the same rows."""
    rng = np.random.default_rng(5)
    w = spark.createDataFrame([(s, f"n{a}", f"n{b}", k, float(x)) for s in "ab" for k, (a, b, x) in enumerate(rng.integers(1, 30, (150, 3)).tolist())], "scenario string, u string, v string, key int, weight double")
    ask = spark.createDataFrame([(s, k, f"n{k}", f"n{k * 7 % 31}") for s in ("a", "b", "none", None) for k in range(1, 25)] + [("a", 90, "n3", None), ("a", 91, None, "n3")], "scenario string, id int, source string, target string")
    want = sorted(map(str, R.routes(ask, w).drop("visited").collect()))
    assert sorted(map(str, R.routes(ask, w, counted=False).drop("visited").collect())) == want
    assert sorted(map(str, R.routes(ask, w, limit=200, counted=False).drop("visited").collect())) == want
    steps = {tuple(r) for r in R.first_steps(ask.where("source <> target"), w, 3).collect()}
    assert steps == {tuple(r) for r in R.first_steps(ask.where("source <> target"), w, 3, 0).collect()} and len(steps) > 50
    some = w.select("scenario", F.col("u").alias("source")).distinct()
    one, two = ({(r.scenario, r.source): (r.reached, r.farthest, round(r.mean_cost, 9)) for r in R.reach_summary(w, some, k).collect()} for k in (None, 0))
    assert one == two


def test_replayed_files_come_in_the_order_of_time(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), 1, "click", 1.0, "{}") for i in range(90)]
    path = f"file://{tmp_path}/replayed"
    S.replayed(spark.createDataFrame(rows, S.SCHEMA), path)
    at = spark.read.parquet(path).select("_metadata.file_name", "_metadata.file_modification_time", "event_id")
    files = at.groupBy("file_name", "file_modification_time").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).orderBy("file_modification_time").collect()
    assert len(files) == len({r.file_modification_time for r in files}) == 3
    assert all(x.b < y.a for x, y in zip(files, files[1:], strict=False))


def test_messages_of_one_time_come_in_their_order():
    rows = pd.DataFrame({"elapsed_s": [5.0, 5.0, 1.0], "seq": [2, 1, 3], "kind": "POSITION", "node": ["b", "a", "z"]})
    assert S.sessions_of(rows, None, 60.0).node.tolist() == ["b"]


@pytest.mark.parametrize("deal", [3, 20_000])
def test_contenders_hold_the_best(spark, monkeypatch, deal):
    """All best k with their ties, few others, wherever groups are dealt; rows without a value stand last."""
    monkeypatch.setattr(M, "DEAL_LEFT", deal)
    monkeypatch.setattr(M, "DEAL_RIGHT", deal)
    left = [(i % 3, i, float(i * 7 % 20)) for i in range(20)] + [(0, 90, None), (9, 91, 1.0), (None, 92, 1.0)]
    right = [(i % 3, i, float(i * 11 % 17)) for i in range(60)] + [(1, 99, None), (None, 98, 1.0)]
    kind = "g int, {0} long, x double"
    got = M.contenders(spark.createDataFrame(left, kind.format("a")), spark.createDataFrame(right, kind.format("b")), "g", "a", "b", "x", lambda i, x, j, y: -abs(x - y), 4)
    found = {tuple(r) for r in got.collect()}
    for g, a, x in left:
        row = sorted((abs(x - y), b) for h, b, y in right if h == g and g is not None and x is not None and y is not None)
        if row:
            assert {(a, b) for d, b in row if d <= row[3][0]} <= found
    assert len([1 for a, _ in found if a == 90]) == 20 and not any(a in (91, 92) for a, _ in found)


def test_shared_ids_by_classes(spark):
    left = spark.createDataFrame([(1, [1, 2, 2]), (2, [2, 1]), (3, [5]), (3, [1]), (4, []), (5, None), (None, [1])], "l long, x array<long>")
    right = spark.createDataFrame([(7, [1, 2]), (8, [5, None]), (9, [1]), (10, [6])], "r long, y array<long>")
    got = [tuple(r) for r in M.share_an_id(left, right, "x", "y", "l", "r").collect()]
    want = {(1, 7, 2), (1, 9, 1), (2, 7, 2), (2, 9, 1), (3, 7, 1), (3, 8, 1), (3, 9, 1), (None, 7, 1), (None, 9, 1)}
    assert len(got) == len(want) and set(got) == want


def moved(df):
    """Shuffles in the plan of the rows of `df`, by what they are dealt by, once it has run."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_points_and_lines_that_meet_are_not_shuffled(spark):
    """Several legs of a line in one cell, lines and points of one id at several places, ids that are null."""
    rng = np.random.default_rng(8)
    spots = [(i, *map(float, rng.uniform(0, 4, 2))) for i in range(60)] + [(7, 3.5, 0.2), (7, 0.1, 3.9), (None, 1.0, 1.0), (None, 3.0, 3.0)]
    lines = [(k % 11, [tuple(map(float, q)) for q in rng.uniform(0, 4, (5, 2))]) for k in range(14)] + [(None, [(1.0, 1.2), (1.1, 1.2)])]
    p, q = spark.createDataFrame(spots, "id int, x double, y double"), spark.createDataFrame(lines, "line int, pts array<struct<x:double,y:double>>")
    want = {}
    for i, x, y in spots:
        for k, pts in lines:
            for (ax, ay), (bx, by) in zip(pts, pts[1:], strict=False):
                dx, dy = bx - ax, by - ay
                t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
                d = np.hypot(x - ax - t * dx, y - ay - t * dy)
                if d <= 0.4:
                    want[i, k] = min(d, want.get((i, k), d))
    for limit in (5, 2_000):
        rows = S2.near_lines(p, q, 0.4, limit).collect()
        assert len(rows) == len(want) and {(r.id, r.line): r.distance for r in rows} == {k: pytest.approx(d) for k, d in want.items()}
    assert not any("hashpartitioning(id" in line for line in moved(S2.near_lines(p.where("id <> 7"), q, 0.4)))


@pytest.mark.parametrize("deal", [2, 7, 1_500])
def test_duplicate_classes_by_deals(spark, monkeypatch, deal):
    """Equal and constant series, null readings, no readings, sensors of several edges, null ids; no pair is shuffled."""
    monkeypatch.setattr(M, "DEAL_SENSORS", deal)
    monkeypatch.setattr(M, "PAIRS", 5)
    rng = np.random.default_rng(3)
    of = {s: {h: float(v) for h, v in enumerate(rng.normal(50 + s, 9, 9)) if rng.random() < 0.7} for s in range(16)}
    of[3], of[4], of[5], of[6] = dict(of[2]), {h: 5.0 for h in range(9)}, {h: 2 * v + 1e6 for h, v in of[2].items()}, {h: 7.0 + 90 * (h == 8) for h in range(9)}
    of[7], of[11] = {h: 1.0 for h in range(8)}, dict(of[2])
    of[8][0] = None
    del of[9]
    on = [(e, s) for s in range(16) for e in ({s % 2, 2, 10} if s % 3 else {s % 2})] + [(2, 2), (None, 1), (1, None)]
    rows = [(s, h, v) for s, t in of.items() for h, v in t.items()] + [(None, 1, 1.0), (1, None, 1.0)]
    mapping, series = spark.createDataFrame(on, "edge int, seg long"), spark.createDataFrame(rows, "seg long, hr int, speed double")
    want = {}
    for a, b in {(s, t) for e, s in on for f, t in on if e == f and e is not None and s is not None and t is not None and s < t}:
        x, y = of.get(a, {}), of.get(b, {})
        both = sorted(set(x) & set(y))
        p, q = (np.array(v, float) for v in zip(*[(x[h], y[h]) for h in both if x[h] is not None and y[h] is not None], strict=True)) if both else (np.array([]), np.array([]))
        r = float(np.corrcoef(p, q)[0, 1]) if len(p) and p.std() > 1e-9 and q.std() > 1e-9 else None
        kind = "D" if len(both) < 3 else "A" if len(p) and np.abs(p - q).max() <= 1e-9 else "B" if r is not None and r >= 0.9 else "C"
        want[a, b] = (len(both), None if r is None else pytest.approx(r, abs=1e-9), kind)
    df = M.duplicate_classes(mapping, series, ["edge"])
    got = df.collect()
    assert len(got) == len(want) and {(r.a, r.b): (r.hours, r.r, r.kind) for r in got} == want
    assert {k for _, _, k in want.values()} == set("ABCD")
    assert all("_e" in line for line in moved(df))


def test_archives_are_written_in_pieces(spark, tmp_path, monkeypatch):
    """Members of many pieces in their order, over batches; and no row of the archived tables holds a member."""
    rows = [(f"a{k % 3}", f"{k % 7}.json", k, f'{{"k": {k}}}') for k in range(12_000)] + [("a0", "t.csv", k, str(k)) for k in range(5)] + [(None, "x", 1, "x"), ("a9", "none.json", 1, None)]
    path = tmp_path / "z"
    frames = {".json": ("[", ", ", "]"), ".csv": ("h\n", "\n", "")}
    df = spark.createDataFrame(rows, "archive string, member string, place int, text string").repartition(5)
    for _ in range(2):
        assert IO.write_archives(df, f"file://{path}", "place", frames) == 4
    assert sorted(f.name for f in path.iterdir() if not f.name.startswith(".")) == ["a0.zip", "a1.zip", "a2.zip", "a9.zip"]
    for i in range(3):
        with zipfile.ZipFile(path / f"a{i}.zip") as z:
            assert z.testzip() is None
            for m in range(7):
                assert [d["k"] for d in json.loads(z.read(f"{m}.json"))] == [k for k in range(12_000) if k % 3 == i and k % 7 == m]
            assert i or z.read("t.csv") == b"h\n0\n1\n2\n3\n4"
    seen = []
    monkeypatch.setattr(IO, "write_archives", lambda members, *a: seen.append(members.agg(F.max(F.length("text"))).first()[0]))
    inventory_queries.archived(spark, "/root/testdata/sf0.01")
    assert seen[0] < 1_000
