"""Ranges, fills, summaries and lookups, and round trips through sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kinematics as K
from ..operators import audit as A
from ..operators import evaluation as V
from ..operators import features as X
from ..operators import matching as M
from ..operators import routing as R
from ..operators import walk as S
from ..scratch import folder
from ..sources import readers as IO
from ..streaming import hourly as ST
from . import road_queries as Q
from .audit_queries import H, sensor
from .registry import query, rounded, table


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'")
def closed_time_range(spark, sf_dir):
    return X.closed_range(table(spark, sf_dir, "orders"), "o_orderdate", "1995-01-01", "1996-12-31").select("o_orderkey", "o_orderdate")


@query("SELECT l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_shipdate FROM lineitem")
def columns_without_suffix(spark, sf_dir):
    return X.drop_suffixes(table(spark, sf_dir, "lineitem"), ["key", "status"])


@query("SELECT l_orderkey AS route, l_linenumber AS step, CASE WHEN l_discount <> 0 THEN round(l_extendedprice / l_discount, 3) END AS ratio, TRY_CAST(l_returnflag AS INTEGER) AS code FROM lineitem")
def cleaned_columns(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "route", "l_linenumber": "step"})
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.try_divide("l_extendedprice", "l_discount"))
    return rounded(d.select("route", "step", X.finite_or_null(ratio).alias("ratio"), F.col("l_returnflag").try_cast("int").alias("code")), "ratio", places=3)


@query(
    H
    + """, d AS (SELECT seg, hr, (epoch(hr) - epoch(lag(hr) OVER (PARTITION BY seg ORDER BY hr))) / 3600 AS step FROM h),
    c AS (SELECT seg, step, count(*) AS k FROM d WHERE step IS NOT NULL GROUP BY 1, 2),
    m AS (SELECT seg, step FROM (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY k DESC, step) AS r FROM c) WHERE r = 1),
    s AS (SELECT seg, count(*) AS n, (epoch(max(hr)) - epoch(min(hr))) / 3600 AS span FROM h GROUP BY 1)
    SELECT seg, n, CAST(step AS BIGINT) AS step_h, CAST(round(span / step, 0) + 1 - n AS BIGINT) AS missing FROM s LEFT JOIN m USING (seg)"""
)
def missing_slots(spark, sf_dir):
    return A.missing_slots(sensor(spark, sf_dir))


@query(
    """WITH m AS (SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1)
    SELECT e.user_id, count(value) AS n, round(sum(value), 3) AS total, round(sum(value * value), 3) AS squares, count(*) FILTER (value = 0) AS zeros, min(value) AS least, max(value) AS most,
    string_agg(DISTINCT e.event_type, ',' ORDER BY e.event_type) AS kinds, any_value(m.event_type) AS usual FROM events e JOIN m USING (user_id) GROUP BY 1"""
)
def segment_running_stats(spark, sf_dir):
    return rounded(A.running_stats(table(spark, sf_dir, "events"), "user_id", "value", "event_type"), "total", "squares", places=3)


@query(H + ", t AS (SELECT *, seg % 4 AS road FROM h), e AS (SELECT road, count(DISTINCT seg) AS segs FROM t GROUP BY 1), s AS (SELECT CAST((epoch(max(hr)) - epoch(min(hr))) / 3600 + 1 AS BIGINT) AS slots FROM h) SELECT road, count(*) AS observed, any_value(segs) * any_value(slots) AS expected, round(100.0 * count(*) / (any_value(segs) * any_value(slots)), 4) AS coverage_pct FROM t JOIN e USING (road), s GROUP BY 1")
def coverage_by_road(spark, sf_dir):
    return rounded(A.coverage_by_class(sensor(spark, sf_dir).withColumn("road", F.col("seg") % 4), "road"), "coverage_pct")


@query("WITH e AS (SELECT event_type, date_trunc('hour', ts) AS hr FROM events), s AS (SELECT min(hr) AS lo, max(hr) AS hi FROM e), g AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hr FROM (SELECT DISTINCT event_type FROM e), s), c AS (SELECT event_type, hr, count(*) AS n FROM e GROUP BY 1, 2) SELECT event_type, hr, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (event_type, hr)")
def filled_grid(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hr"))
    return A.filled(e.groupBy("event_type", "hr").agg(F.count("*").alias("n")), "event_type", "hr", "n")


@query("SELECT CASE WHEN h BETWEEN 9 AND 11 THEN 'morning_peak' WHEN h BETWEEN 17 AND 20 THEN 'evening_peak' WHEN h BETWEEN 12 AND 16 THEN 'midday' ELSE 'off_peak' END AS period, count(*) AS n, round(avg(value), 4) AS mean_value FROM (SELECT hour(ts) AS h, value FROM events) GROUP BY 1")
def period_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(K.period(F.hour("ts")).alias("period"))
    return rounded(e.agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")), "mean_value")


@query("SELECT user_id, arg_min(value, (ts, event_id)) AS first_row, arg_min(value, (ts, event_id)) FILTER (event_type = 'purchase') AS first_purchase FROM events GROUP BY 1")
def first_known(spark, sf_dir):
    """The first row, and the first row that has the column at all."""
    e = table(spark, sf_dir, "events").withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("value")))
    at = F.struct("ts", "event_id")
    return e.groupBy("user_id").agg(F.min_by("value", at).alias("first_row"), X.first_known("bought", at).alias("first_purchase"))


@query("SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 5) AS pearson, round(corr(l_quantity, l_extendedprice) * sqrt((count(*) - 2) / (1 - corr(l_quantity, l_extendedprice) ** 2)), 3) AS t FROM lineitem GROUP BY 1")
def correlation_by_group(spark, sf_dir):
    r = F.corr("l_quantity", "l_extendedprice")
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), r.alias("pearson"))
    g = g.withColumn("t", F.col("pearson") * F.sqrt((F.col("n") - 2) / (1 - F.col("pearson") ** 2)))
    return rounded(rounded(g, "t", places=3), "pearson", places=5)


@query("SELECT count(*) AS n, count(*) FILTER (x BETWEEN -90 AND 90 AND y BETWEEN -180 AND 180) AS in_bounds, count(*) FILTER (x > 0) AS positive, count(*) FILTER (isinf(x) OR isinf(y)) AS infinite, count(*) FILTER (isnan(x) OR isnan(y)) AS nan FROM (SELECT CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y FROM embeddings)")
def coordinate_checks(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(*((F.col("embedding")[i].cast("double") * 100).alias(c) for i, c in enumerate("xy")))
    return A.coordinate_checks(e, "x", "y")


@query(Q.E + " SELECT u, v, key, max(seg) AS seg, count(*) AS sensors FROM m GROUP BY 1, 2, 3")
def last_sensor_of_edge(spark, sf_dir):
    return M.last_writer(Q.mapping(spark, sf_dir, Q.edges(spark, sf_dir)), ["u", "v", "key"], "seg", "seg")


@query(Q.E + Q.OD + f", c AS (SELECT od.od AS id, o.v, o.key, row_number() OVER (PARTITION BY od.od ORDER BY (o.v = od.source), md5(od.od || '>' || o.v || '#' || o.key), o.v, o.key) AS rank FROM od JOIN {Q.OBS} o ON o.u = od.source) SELECT id, v, key, rank FROM c WHERE rank <= 2")
def random_candidates(spark, sf_dir):
    """Two edges of each state in a random but repeatable order, that of a hash."""
    w = Q.all_weights(spark, sf_dir).where("scenario = 'observed'")
    s = Q.od(spark, sf_dir).select(F.col("od").alias("id"), F.col("source").alias("at"), F.lit(None).cast("string").alias("prev"), F.array("source").alias("visited"))
    return S.candidates(s, w, score=S.random_order("id")).select("id", "v", "key", "rank")


@query(Q.E + Q.OD + Q.WALK + Q.WIDE + f" SELECT CASE WHEN od % 2 = 0 THEN 'peak' ELSE 'off_peak' END AS period, count(*) AS n, round(avg(static_s), 4) AS mean_static, round(avg(predicted_s), 4) AS mean_predicted, round(quantile_cont(static_s - predicted_s, 0.5), 4) AS median_saving, round(100.0 * count(*) FILTER (predicted_s < static_s - 1e-6) / count(*), 4) AS win_pct, round(100.0 * count(*) FILTER (abs(predicted_s - observed_s) <= 5) / count(*), 4) AS within_5s_pct, round(avg({Q.JAC.format(a='predicted_path', b='observed_path')}), 4) AS mean_overlap FROM x GROUP BY 1")
def route_period_summary(spark, sf_dir):
    x = Q.wide(spark, sf_dir).withColumn("period", F.when(F.col("od") % 2 == 0, "peak").otherwise("off_peak"))
    s = V.period_summary(x.withColumn("overlap", R.jaccard("predicted_path", "observed_path")), "period")
    return rounded(s, *(c for c in s.columns if c not in ("period", "n")))


PERCENTS = ", ".join(f"round(100.0 * count(*) FILTER (saving_s >= min_s AND saving_pct >= {p}) / count(*), 4) AS p{p}" for p in Q.PERCENTS)


@query(Q.E + Q.OD + Q.WALK + Q.REPLAY + f", pz AS (SELECT CASE WHEN abs(saving_s) < 1e-9 THEN 0 ELSE saving_s END AS saving_s, CASE WHEN abs(saving_s) < 1e-9 THEN 0 ELSE saving_pct END AS saving_pct FROM jr) SELECT min_s, {PERCENTS} FROM pz, (SELECT CAST(a AS DOUBLE) AS min_s FROM unnest({Q.SECONDS}) y(a)) GROUP BY 1")
def threshold_pivot(spark, sf_dir):
    """Share of journeys that each pair of thresholds reroutes: seconds down, percents across."""
    clean = Q.replays(spark, sf_dir).withColumns({c: F.when(F.abs("saving_s") < 1e-9, 0.0).otherwise(F.col(c)) for c in ("saving_s", "saving_pct")})
    s = V.policy_summary(clean, V.grid(spark, Q.SECONDS, Q.PERCENTS))
    p = s.groupBy("min_s").pivot("min_pct", [float(p) for p in Q.PERCENTS]).agg(F.first("reroute_pct"))
    return rounded(p.toDF("min_s", *(f"p{p}" for p in Q.PERCENTS)), *(f"p{p}" for p in Q.PERCENTS))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber * 7 % 25 AS DOUBLE) + 0.5 AS pct, l_linenumber * 7 % 25 >= 10 AS triggered FROM lineitem")
def policy_from_reason(spark, sf_dir):
    """The percent as the reason's text has it, which goes before the computed one."""
    reason = F.concat(F.lit("saving "), (F.col("l_linenumber") * 11).cast("string"), F.lit(" s ("), (F.col("l_linenumber") * 7 % 25).cast("string"), F.lit(".5%) against 10 s"))
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", reason.alias("reason"), F.lit(0.0).alias("computed"))
    return d.withColumn("pct", F.coalesce(V.percent_in("reason"), "computed")).select("l_orderkey", "l_linenumber", "pct", (F.col("pct") >= 10).alias("triggered"))


EVENTS = "event_id long, user_id long, event_type string, value double"


@query("SELECT event_id, user_id, event_type, value FROM events")
def csv_round_trip(spark, sf_dir):
    path = folder(spark)
    IO.write_csv(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), path)
    return IO.csv(spark, path, EVENTS)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_round_trip(spark, sf_dir):
    """One document that holds an array, and one object a line."""
    one, lines = folder(spark), folder(spark)
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in n.schema)
    IO.write_json_summary(n, lines)
    back = spark.read.schema(kind).json(lines)
    back.agg(F.to_json(F.collect_list(F.struct(*n.columns)))).coalesce(1).write.text(one)
    return IO.documents(spark, one, kind)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def cached_result(spark, sf_dir):
    """Computed the first time, read from its table the second."""
    path = folder(spark)
    IO.cached(spark, path, lambda: table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")))
    return IO.cached(spark, path, lambda: spark.sql("SELECT raise_error('computed again')"))


@query("SELECT event_type, count(*) AS n, 'a' AS run_id FROM events GROUP BY 1 UNION ALL SELECT event_type, count(*), 'b' FROM events WHERE value > 50 GROUP BY 1")
def exported_runs(spark, sf_dir):
    path, e = folder(spark), table(spark, sf_dir, "events")
    for run, part in (("a", e), ("b", e.where("value > 50"))):
        IO.export_run(part.groupBy("event_type").agg(F.count("*").alias("n")), path, run)
    return IO.parquet(spark, path, ["event_type", "n", "run_id"])


@query(Q.E + " SELECT u, v, CAST(key AS VARCHAR) AS key, highway, round(length_m, 4) AS length_m FROM e")
def graphml_scan(spark, sf_dir):
    """The network written as GraphML, and read with its attributes."""
    path = folder(spark)
    IO.write_graphml(Q.edges(spark, sf_dir).select("u", "v", "key", "highway", "length_m"), path)
    _, edges = IO.graphml(spark, path)
    return rounded(edges.select("u", "v", "key", "highway", F.col("length_m").cast("double").alias("length_m")), "length_m")


def archived(spark, sf_dir):
    """ZIP files, one a region: a GeoJSON document for each nation's customers, and a CSV file of its suppliers."""
    path = folder(spark)
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("archive"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    counts = F.array(*(F.struct(F.lit(t).alias("timeSet"), F.lit("x").alias("dateRange"), (F.col("c_custkey") * 10 + t).alias("probeCount")) for t in (0, 1)))
    line = F.struct(F.lit("LineString").alias("type"), F.array(F.array(F.lit(85.0), F.lit(20.0)), F.array(F.lit(86.0), F.lit(21.0))).alias("coordinates"))
    q = F.struct(F.col("c_custkey").alias("segmentId"), (F.col("c_custkey") % 7).alias("frc"), F.col("c_name").alias("streetName"), F.lit(50).alias("speedLimit"), F.lit(10.5).alias("distance"), counts.alias("segmentProbeCounts"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), line.alias("geometry"), q.alias("properties")))
    # A member is many pieces, which are joined up where it is written.
    name = lambda ending: F.concat(F.col("n_nationkey").cast("string"), F.lit(ending)).alias("member")
    docs = c.select("archive", name(".geojson"), F.col("c_custkey").alias("place"), feature.alias("text"))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.concat(some("s_suppkey"), F.lit(',"'), some("s_name"), F.lit('\n",'), some("s_acctbal"))
    files = s.select("archive", name(".csv"), F.col("s_suppkey").alias("place"), row.alias("text"))
    frames = {".geojson": ('{"type": "FeatureCollection", "features": [', ", ", "]}"), ".csv": ("key,name,balance\n", "\n", "")}
    IO.write_archives(docs.unionByName(files), path, "place", frames)
    return path


@query("SELECT 'region-' || n_regionkey AS archive, n_nationkey || '.geojson' AS member, 'geojson' AS kind, count(*) AS rows, CAST(6 AS BIGINT) AS columns FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey UNION ALL SELECT 'region-' || n_regionkey, n_nationkey || '.csv', 'csv', count(*), 3 FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey")
def archive_inventory(spark, sf_dir):
    """Rows and columns of each member, by a task a member."""
    m = IO.zip_members(spark, archived(spark, sf_dir))
    return m.select(F.regexp_extract("archive", r"([^/]+)\.zip$", 1).alias("archive"), "member", "kind", "rows", "columns")


@query("SELECT kind, count(*) AS members, CAST(sum(n) AS BIGINT) AS rows, CAST(max(w) AS BIGINT) AS columns FROM (SELECT 'geojson' AS kind, count(*) AS n, 6 AS w FROM customer GROUP BY c_nationkey UNION ALL SELECT 'csv', count(*), 3 FROM supplier GROUP BY s_nationkey) GROUP BY 1")
def archive_kinds(spark, sf_dir):
    """Members, rows and columns by type."""
    m = IO.zip_members(spark, archived(spark, sf_dir)).groupBy("kind")
    return m.agg(F.count("*").alias("members"), F.sum("rows").alias("rows"), F.max("columns").alias("columns"))


@query("SELECT c_custkey AS segment_id, CAST(c_custkey % 7 AS INTEGER) AS frc, c_name AS street, CAST(t AS INTEGER) AS time_set, c_custkey * 10 + t AS probes FROM customer, range(2) r(t)")
def zipped_geojson_scan(spark, sf_dir):
    """A row for each segment and time set of the zipped feature collections."""
    return IO.zipped_geojson(spark, archived(spark, sf_dir)).select("segment_id", "frc", "street", "time_set", "probes")


SHAPED = "VALUES ('object', 'OBJECT<k: BIGINT>'), ('list', 'ARRAY<OBJECT<k: BIGINT>>'), ('feature_collection', 'OBJECT<features: ARRAY<OBJECT<k: BIGINT>>>'), ('feature', 'OBJECT<properties: OBJECT<k: BIGINT>, type: STRING>'), ('facilities', 'OBJECT<facilities: ARRAY<OBJECT<k: BIGINT>>, n: DECIMAL(2,1)>'), ('value', 'BIGINT'), ('broken', 'VOID')"


@query(f"SELECT kind, (SELECT count(*) FROM events) AS n, schema FROM ({SHAPED}) t(kind, schema)")
def json_shapes(spark, sf_dir):
    """Documents of every kind made around the events' properties: what they are, and the schema that those of a kind have in common."""
    p = F.col("props")
    around = lambda a, b: F.concat(F.lit(a), p, F.lit(b))
    texts = F.array(p, around("[", "]"), around('{"features": [', "]}"), around('{"type": "Feature", "properties": ', "}"), around('{"n": 1.5, "facilities": [', "]}"), F.get_json_object("props", "$.k"), F.lit("{text"))
    return IO.json_shapes(table(spark, sf_dir, "events").select(F.explode(texts).alias("t")), "t")


def event_stream(spark, sf_dir):
    """The events table as a stream of some files."""
    return ST.replayed(table(spark, sf_dir, "events"), folder(spark))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS speed FROM events GROUP BY 1")
def stream_latest_values(spark, sf_dir):
    """The last value of each segment, merged batch by batch."""
    path = folder(spark)
    ST.latest_table(event_stream(spark, sf_dir), path, folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return ST.read_latest(spark, path).select("user_id", "speed")


@query(
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS vehicle, epoch(ts) AS t, event_type, event_id, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w > 43200 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY vehicle ORDER BY t, event_id) AS k FROM e)
    SELECT vehicle, round(min(t), 3) AS first_s, round(max(t), 3) AS elapsed_s, arg_max(event_type, (t, event_id)) AS node, count(*) AS updates, CAST(0 AS BIGINT) AS late, count(*) FILTER (event_type = 'purchase') AS reroutes FROM s GROUP BY vehicle, k"""
)
def stream_vehicle_states(spark, sf_dir):
    """Sessions of each vehicle, twelve hours of silence apart, after all messages."""
    kind = F.when(F.col("event_type") == "purchase", "ROUTE_UPDATE").otherwise("POSITION")
    m = event_stream(ST.with_state_store(spark), sf_dir).select(F.col("user_id").cast("string").alias("vehicle"), kind.alias("kind"), F.col("event_type").alias("node"), "ts", F.col("event_id").alias("seq"))
    path = folder(spark)
    ST.last_states(ST.vehicles(m, 12 * 3600.0), path, folder(spark)).trigger(availableNow=True).start().awaitTermination()
    fields = ["elapsed_s", "node", "updates", "late", "reroutes"]
    last = spark.read.parquet(f"{path}/*").groupBy("vehicle", "first_s").agg(F.max_by(F.struct(*fields), "updates").alias("_s"))
    return rounded(last.select("vehicle", "first_s", "_s.*"), "first_s", "elapsed_s", places=3)


@query("SELECT event_id, user_id AS source, event_type AS type FROM events")
def stream_event_log(spark, sf_dir):
    path = folder(spark)
    ST.event_log(event_stream(spark, sf_dir), path, folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("event_id", "source", "type")




@query("SELECT event_type, count(*) AS n, kind AS run_id FROM events, (VALUES ('csv'), ('json')) t(kind) GROUP BY ALL")
def exported_texts(spark, sf_dir):
    """Runs exported as CSV and as JSON, and read again."""
    n, out = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")), None
    for kind in ("csv", "json"):
        path = folder(spark)
        IO.export_run(n, path, kind, kind)
        back = spark.read.format(kind).option("header", True).schema("event_type string, n long, run_id string").load(path)
        out = back if out is None else out.unionByName(back)
    return out


@query("SELECT event_type, 'parquet' AS kind, true AS is_filled FROM events GROUP BY 1")
def file_listing(spark, sf_dir):
    """What lies in a folder of parts: the catalogue without the contents."""
    path = folder(spark)
    table(spark, sf_dir, "events").repartition("event_type").write.partitionBy("event_type").parquet(path)
    files = IO.listing(spark, path).where("kind = 'parquet'")
    part = F.regexp_extract("path", "event_type=([^/]+)/", 1)
    return files.groupBy(part.alias("event_type"), "kind").agg((F.sum("bytes") > 0).alias("is_filled"))
