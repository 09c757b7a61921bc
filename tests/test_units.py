"""Statistics, features, matching, sources and streams on small inputs."""

import datetime
import io
import json
import math
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkway.functions import tails as K
from sparkway.operators import audit as A
from sparkway.operators import features as X
from sparkway.operators import matching as M
from sparkway.operators import ranks
from sparkway.operators import spatial as SP
from sparkway.operators import statistics as T
from sparkway.sources import readers as S
from sparkway.streaming import hourly as H


def test_paired_battery(spark):
    """Twenty journeys, eight of which save 84.9 s."""
    d = spark.createDataFrame([(84.9 if i < 8 else 0.0, 0.0) for i in range(20)], "a double, b double")
    one = T.paired(d, "a", "b").first().asDict()
    assert one["mean"] == pytest.approx(33.96) and one["std"] == pytest.approx(42.68, abs=0.01)
    assert one["cohens_d"] == pytest.approx(0.7958, abs=1e-4) and one["t"] == pytest.approx(3.559, abs=1e-3)
    v = T.verdicts(d.withColumn("g", F.lit("x")), "a", "b", ["g"]).first()
    assert v.normality_p == pytest.approx(1.5949e-06, rel=1e-3) and v.primary == "signed_rank" and v.verdict == "p < 0.01"


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_tails(spark):
    t = lambda x, df: value(spark, K.t_tail(F.lit(float(x)), F.lit(float(df))))
    assert t(2, 10) == pytest.approx(0.07338803, abs=1e-7) and t(0, 5) == pytest.approx(1.0) and t(12.706205, 1) == pytest.approx(0.05, abs=1e-7)
    assert t(1.96, 1e6) == pytest.approx(0.049996068, abs=1e-8) and t(40, 3) == pytest.approx(1 - 2 / math.pi * (math.atan(40 / 3**0.5) + 40 * 3**0.5 / 1603), rel=1e-6)
    rank = lambda n, w, ties: value(spark, K.signed_rank_p(F.lit(n), F.lit(float(w)), F.lit(ties)))
    assert rank(5, 0, 0) == pytest.approx(0.0625) and rank(0, 0, 0) == 1.0 and rank(10, 8, 0) == pytest.approx(0.048828125) and rank(6, 10.5, 0) == pytest.approx(1.0)
    z = lambda x: value(spark, K.normal_tail(F.lit(float(x))))
    assert z(1.959964) == pytest.approx(0.05, abs=1e-6) and z(0) == pytest.approx(1.0) and z(-3) == pytest.approx(0.0026997960632602) and z(8) == pytest.approx(1.2441921148543574e-15, rel=1e-9)
    assert value(spark, K.log_gamma(F.lit(0.5))) == pytest.approx(0.5723649429247) and value(spark, K.log_gamma(F.lit(150.5))) == pytest.approx(math.lgamma(150.5))
    assert value(spark, K.correlation_p(F.lit(0.5), F.lit(12))) == pytest.approx(0.0978534, abs=1e-5) and value(spark, K.correlation_p(F.lit(1.0), F.lit(12))) == 0.0 and value(spark, K.correlation_p(F.lit(0.5), F.lit(2))) is None


def test_small_samples(spark):
    """The weights of eleven men, as published: W = 0.79, p under 0.01; and samples of every size allowed."""
    men = [148.0, 154.0, 158.0, 160.0, 161.0, 162.0, 166.0, 170.0, 182.0, 195.0, 236.0]
    w, p = value(spark, K.shapiro(F.array(*map(F.lit, men))))
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.0067, abs=0.0005)
    even = lambda n: value(spark, K.shapiro(F.array(*(F.lit(float(i)) for i in range(n)))))
    assert all(even(n).p > 0.4 for n in range(3, K.SMALL + 1)) and even(3).w == pytest.approx(1.0)
    assert value(spark, K.shapiro(F.array(*[F.lit(1.0)] * 5))) is None and value(spark, K.shapiro(F.array(F.lit(1.0), F.lit(2.0)))) is None
    assert all(sum(x * x for x in K.shapiro_weights(n)) == pytest.approx(1.0) for n in range(3, K.SMALL + 1))


def test_groups_of_every_size(spark):
    """None to judge, one row, equal rows, few and many."""
    rows = [("one", 1.0, 0.0), *[("same", 2.0, 1.0)] * 6, *[("few", float(i), 0.0) for i in range(8)], *[("many", float(i % 9), 4.0) for i in range(90)], ("none", None, 1.0)]
    got = {r.g: r for r in T.verdicts(spark.createDataFrame(rows, "g string, a double, b double"), "a", "b", ["g"]).collect()}
    assert set(got) == {"one", "same", "few", "many"} and got["one"].t_p is None and got["one"].primary == "signed_rank"
    assert got["same"].normality_p is None and got["same"].signed_rank_p == pytest.approx(K_NORMAL) and got["few"].primary == "paired_t" and got["many"].n == 90


K_NORMAL = math.erfc(10.5 / math.sqrt(6 * 7 * 13 / 24 - 210 / 48) / math.sqrt(2))


def test_average_ranks(spark):
    d = spark.createDataFrame([(x,) for x in (3.0, 1.0, 3.0, 2.0, None)], "x double")
    assert sorted((r.x is None, r.x or 0, r.r) for r in ranks.average_rank(d.where("x is not null"), "x", "r").collect()) == [(False, 1.0, 1.0), (False, 2.0, 2.0), (False, 3.0, 3.5), (False, 3.0, 3.5)]


def test_rolling_waits_for_full_windows(spark):
    d = spark.range(5).select(F.lit("a").alias("seg"), F.col("id").alias("hr"), F.col("id").cast("double").alias("speed"))
    r = X.rolling(d, means=(3,), stds=(3,)).orderBy("hr").collect()
    assert [x.mean_3 for x in r] == [None, None, 1.0, 2.0, 3.0] and [x.std_3 for x in r] == [0.0, 0.0, 1.0, 1.0, 1.0]


def test_lag_correlation_leaves_gaps_out(spark):
    rows = [("a", f"2024-01-01 {h:02d}:00:00", float(h % 5)) for h in range(20) if h != 7]
    d = spark.createDataFrame(rows, "seg string, hr string, speed double").withColumn("hr", F.to_timestamp("hr"))
    assert A.lag_correlation(d, [1]).first().pairs == 17


def test_runs(spark):
    d = spark.createDataFrame([("a", s) for s in (1, 2, 3, 5, 9)], "k string, s long")
    r = A.run_summary(A.runs(d, "k", F.col("s")), "k").first()
    assert (r.n_runs, r.longest, r.gaps_1, r.gaps_2_plus, r.max_gap) == (3, 3, 1, 1, 3)


def test_period_bins_are_right_closed(spark):
    from sparkway.functions.kinematics import right_closed_bin

    got = [r[0] for r in spark.createDataFrame([(0.0,), (4000.0,), (4000.1,), (8000.0,)], "x double").select(right_closed_bin(F.col("x"), [0, 4000, 8000])).collect()]
    assert got == [None, 0, 1, 1]


def test_utm(spark):
    x, y = spark.range(1).select(*M.utm(F.lit(20.2961), F.lit(85.8245), 87.0)).first()
    assert 376000 < x < 378500 and 2244000 < y < 2246000
    e, n = spark.range(1).select(*M.utm(F.lit(0.0), F.lit(87.0), 87.0)).first()
    assert e == pytest.approx(500000.0) and n == pytest.approx(0.0, abs=1e-6)


def test_point_to_line(spark):
    p = spark.createDataFrame([(1, 5.0, 3.0), (2, 20.0, 0.0)], "id long, x double, y double")
    line = spark.createDataFrame([(9, [(0.0, 0.0), (10.0, 0.0), (10.0, 5.0)])], "line long, pts array<struct<x:double,y:double>>")
    assert [(r.id, r.line, r.distance) for r in SP.near_lines(p, line, 4.0).collect()] == [(1, 9, 3.0)]
    assert line.select(M.line_length("pts")).first()[0] == 15.0


def test_canonical_key_ignores_direction(spark):
    r = spark.sql("select array(1, 2, 3) a, array(3, 2, 1) b, array(1, 3, 2) c").select(M.canonical_key(F.col("a")), M.canonical_key(F.col("b")), M.canonical_key(F.col("c"))).first()
    assert r[0] == r[1] != r[2]


def test_ids_in_lists(spark):
    d = spark.createDataFrame([("[12, 7, 12]",), ("5",), (None,)], "x string")
    assert [r[0] for r in d.select(M.ids_in(F.col("x"))).collect()] == [[12, 7], [5], None]


def test_nearest_time(spark):
    t = spark.sql("select timestamp'2024-01-01 00:00:00' t union all select timestamp'2024-01-01 02:00:00'")
    q = spark.sql("select timestamp'2024-01-01 01:00:00' q union all select timestamp'2024-01-01 01:30:00' union all select timestamp'2023-01-01 00:00:00' union all select timestamp'2025-01-01 00:00:00'")
    got = {str(r.q): str(r.nearest) for r in X.nearest_in_time(q, t, "q", "t").collect()}
    assert got == {"2024-01-01 01:00:00": "2024-01-01 00:00:00", "2024-01-01 01:30:00": "2024-01-01 02:00:00", "2023-01-01 00:00:00": "2024-01-01 00:00:00", "2025-01-01 00:00:00": "2024-01-01 02:00:00"}


GRAPHML = """<?xml version="1.0"?><graphml><key id="d0" for="node" attr.name="y" attr.type="string"/><key id="d1" for="edge" attr.name="length" attr.type="string"/>
<graph><node id="1"><data key="d0">20.5</data></node><node id="2"/><edge source="1" target="2" id="0"><data key="d1">12.5</data></edge></graph></graphml>"""


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPHML)
    nodes, edges = S.graphml(spark, f"file://{tmp_path}/g.graphml")
    assert sorted((r.id, r.y) for r in nodes.collect()) == [("1", "20.5"), ("2", None)]
    assert [(r.u, r.v, r.key, r.length) for r in edges.collect()] == [("1", "2", "0", "12.5")]


def test_zip(spark, tmp_path):
    feature = {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, "properties": {"segmentId": 7, "frc": 3, "streetName": "x", "speedLimit": 50, "distance": 9.5, "segmentProbeCounts": [{"timeSet": 2, "dateRange": 0, "probeCount": 5}, {"timeSet": 3, "dateRange": 0, "probeCount": 0}]}}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/1.geojson", json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"zoneId": "z"}}, feature]}))
        z.writestr("r.txt", "hello")
        z.writestr("n.csv", 'a,b\n1,"two\nlines"\n3,4\n')
        z.writestr("list.json", "[1, {\"p\": 2, \"q\": 3}, 4.5]")
        z.writestr("one.json", '{"p": [1, 2], "type": "x"}')
        z.writestr("broken.json", '{"features": [{"a": 1}, {"a"')
        z.writestr("empty.csv", "")
    got = {r.member: (r.kind, r.rows, r.columns, r.problem is None) for r in S.zip_members(spark, f"file://{tmp_path}/a.zip").collect()}
    assert got == {"d/1.geojson": ("geojson", 2, 7, True), "r.txt": ("txt", None, None, True), "n.csv": ("csv", 2, 2, True), "list.json": ("json", 3, 2, True), "one.json": ("json", 1, 2, True), "broken.json": ("json", None, None, False), "empty.csv": ("csv", 0, 0, True)}
    for path in (f"file://{tmp_path}", f"{tmp_path}/a.zip"):
        assert S.zip_members(spark, path).count() == 7
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        for i in range(20):
            z.writestr(f"{i}.geojson", json.dumps({"features": [feature] * i}))
    df = S.zipped_geojson(spark, f"{tmp_path}/b.zip")
    assert df.rdd.getNumPartitions() == 20 and df.count() == 2 * 190
    with pytest.raises(Exception, match="breaks off"):
        S.zipped_geojson(spark, f"{tmp_path}/a.zip").count()
    with pytest.raises(Exception, match="no archive"):
        S.zip_members(spark, f"{tmp_path}/nothing").count()


def test_json_items_over_blocks():
    """Documents cut at every place of the stream."""
    from sparkway.sources.archives import json_items

    for text, want in (('{"a": 12, "features": [{"x": "]"}, 34, "[5"], "z": 1}', ["feature"] * 3), ("[10, [2], {}]", ["item"] * 3), ('{"a": {"features": [1]}}', ["document"]), (" 5.25 ", ["document"]), ("[]", [])):
        for block in (1, 2, 3, 7, 100):
            got = list(json_items(io.StringIO(text), block))
            assert [w for w, _ in got] == want
            whole = json.loads(text)
            assert [v for _, v in got] == (whole["features"] if want == ["feature"] * 3 else whole if isinstance(whole, list) else [whole])


def test_archives_written_and_read(spark, tmp_path):
    rows = [("one", "a.csv", "x,y\n1,2\n"), ("one", "b.json", "[]"), ("two", "c.json", None), (None, "d", "x")]
    assert S.write_archives(spark.createDataFrame(rows, "archive string, member string, text string"), f"file://{tmp_path}/z") == 2
    got = {(r.member, r.rows) for r in S.zip_members(spark, f"file://{tmp_path}/z").collect()}
    assert got == {("a.csv", 1), ("b.json", 0), ("c.json", None)}


def test_json_kinds(spark):
    texts = {'{"type": "Feature", "properties": {}}': "feature", '{"features": []}': "feature_collection", '{"facilities": [1]}': "facilities", '{"type": "x"}': "object", "[1]": "list", "7": "value", "null": "value", "{oops": "broken", "": "broken", None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.k for r in df.select("t", S.json_kind("t").alias("k")).collect()} == texts
    assert {r.kind: r.n for r in S.json_shapes(df, "t").collect()} == {"feature": 1, "feature_collection": 1, "facilities": 1, "object": 1, "list": 1, "value": 2, "broken": 2}


def test_cached_csv_json(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3).withColumn("x", F.lit("a"))
    p = f"file://{tmp_path}/c"
    assert S.cached(spark, p, make).count() == S.cached(spark, p, make).count() == 3 and len(calls) == 1
    S.write_csv(spark.range(2), f"file://{tmp_path}/csv")
    assert S.csv(spark, f"file://{tmp_path}/csv", "id long").count() == 2
    S.write_json_summary(spark.range(2), f"file://{tmp_path}/j")
    assert spark.read.text(f"file://{tmp_path}/j").count() == 2
    S.export_run(spark.range(2), f"file://{tmp_path}/runs", "r1")
    assert S.parquet(spark, f"file://{tmp_path}/runs", ["id"], "run_id = 'r1'").count() == 2


MESSAGE = "vehicle string, kind string, node string, ts timestamp"
BEGIN = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def write_files(spark, tmp_path, files, schema):
    """One folder a micro-batch, in the order of their times."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/f={i}")
        for f in (tmp_path / f"in/f={i}").iterdir():
            os.utime(f, (1_700_000_000 + 10 * i,) * 2)
    return schema + ", f int"


def replayed(spark, tmp_path, files, idle=30.0, late="10 seconds"):
    """Rows that the session stream gave, one micro-batch a file, in seconds from the first day; and what its state holds at the end."""
    at = lambda x: x if x is None else BEGIN + datetime.timedelta(seconds=x)
    schema = write_files(spark, tmp_path, [[(v, k, n, at(t)) for v, k, n, t in rows] for rows in files], MESSAGE)
    stream = H.with_state_store(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    H.last_states(H.vehicles(stream, idle, late), f"file://{tmp_path}/out", f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    zero = BEGIN.timestamp()
    seen = [(r.vehicle, r.first_s - zero, r.elapsed_s - zero, *tuple(r)[3:]) for r in spark.read.parquet(f"file://{tmp_path}/out/*").collect()]
    held = spark.read.format("statestore").option("stateVarName", "session").load(f"file://{tmp_path}/ck").count()
    return seen, held


def test_vehicle_sessions(spark, tmp_path):
    """Late messages and those without a time are counted and move nothing; a pause ends a session; nobody's messages are left out."""
    files = [[("v1", "POSITION", "a", 1.0), ("v1", "ROUTE_UPDATE", "b", 5.0), ("v2", "POSITION", "c", 2.0), (None, "POSITION", "x", 3.0)], [("v1", "POSITION", "old", 4.0), ("v1", "POSITION", "d", 9.0), ("v1", "POSITION", "none", None), ("v2", "ROUTE_UPDATE", "e", 50.0)]]
    seen, _ = replayed(spark, tmp_path, files, late="1 hour")
    last = {}
    for v, first, elapsed, node, n, late, reroutes, ended in seen:
        last[v, first] = max(last.get((v, first), (0,)), (n, elapsed, node, late, reroutes, ended))
    assert last == {("v1", 1.0): (5, 9.0, "d", 2, 1, False), ("v2", 2.0): (1, 2.0, "c", 0, 0, True), ("v2", 50.0): (1, 50.0, "e", 0, 1, False)}


def test_state_stays_bounded_over_a_long_replay(spark, tmp_path):
    """A new vehicle every second, each for ten seconds: state holds those about the watermark, not all."""
    every = [(f"v{i}", "POSITION", "n", float(t)) for i in range(600) for t in range(i, i + 10, 3)]
    files = [[r for r in every if 60 * k <= r[3] < 60 * (k + 1)] for k in range(11)]
    seen, held = replayed(spark, tmp_path, files, idle=20.0, late="5 seconds")
    ended = {r[0] for r in seen if r[-1]}
    assert {r[0] for r in seen} == {f"v{i}" for i in range(600)} and len(ended) >= 500 and held <= 100
    assert all(r[4] == 4 for r in seen if r[-1])


def test_latest_table_rewrites_touched_buckets(spark, tmp_path):
    at = lambda x: BEGIN + datetime.timedelta(hours=x)
    schema = write_files(spark, tmp_path, [[(i, at(i), i, "a", float(i), None) for i in range(50)], [(100, at(1), 3, "a", -1.0, None), (101, at(99), 4, "a", 7.5, None)]], H.SCHEMA)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    H.latest_table(stream, f"file://{tmp_path}/t", f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = {r.user_id: r.speed for r in H.read_latest(spark, f"file://{tmp_path}/t").collect()}
    assert got == {i: float(i) for i in range(50)} | {4: 7.5}
    parts = H._parts(spark, f"file://{tmp_path}/t")
    assert 1 <= sum("epoch=1/" in p for p in parts.values()) <= 2 < sum("epoch=0/" in p for p in parts.values())


def test_closed_hours_are_appended_once(spark, tmp_path):
    at = lambda h, m: BEGIN + datetime.timedelta(hours=h, minutes=m)
    files = [[(1, at(1, 5), 7, "a", 10.0, None), (2, at(1, 50), 7, "a", 20.0, None)], [(3, at(5, 0), 7, "a", 5.0, None)], [(5, at(9, 30), 8, "a", 1.0, None)], [(4, at(1, 55), 7, "a", 99.0, None)]]
    schema = write_files(spark, tmp_path, files, H.SCHEMA)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    H.hourly_means(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    closed = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted((r.seg, r.hr.hour, r.speed, r.n) for r in closed.collect()) == [(7, 1, 15.0, 2), (7, 5, 5.0, 1)]
    rest = H.open_hours(spark.read.parquet(f"file://{tmp_path}/in"), closed)
    assert [(r.seg, r.hr.hour, r.speed) for r in rest.collect()] == [(8, 9, 1.0)]


def test_free_distance(spark):
    from sparkway.functions.kinematics import haversine

    d = spark.range(1).select(haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0]
    assert d == pytest.approx(math.pi / 180 * 6_371_000.0)


def test_edge_points(spark):
    e = spark.createDataFrame([("a", "b", "LINESTRING (1 2, 3 4.5)"), ("a", "b", None), ("a", "b", "POINT (1 2)")], "u string, v string, geometry string")
    n = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 1.0)], "node string, x double, y double")
    got = [[(p.x, p.y) for p in r.pts] for r in M.edge_points(e, n).collect()]
    assert sorted(got) == sorted([[(1.0, 2.0), (3.0, 4.5)], [(0.0, 0.0), (1.0, 1.0)], [(0.0, 0.0), (1.0, 1.0)]])


def test_sql_functions(spark):
    from sparkway.functions.sql import register

    register(spark)
    r = spark.sql("select travel_time_s(1000D, 36D), set_jaccard(array('a'), array('a', 'b')), gate_open(200D, 150D, 10D, 3D), speed_class(20D)").first()
    assert (r[0], r[1], r[2], r[3]) == (pytest.approx(100.0), 0.5, True, "moderate")
