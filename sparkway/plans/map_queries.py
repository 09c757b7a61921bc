"""Segments against the map: several ids, lines that run along each other, projected coordinates, reciprocal geometry, confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import spatial as SP
from . import road_queries as Q
from .registry import query, rounded, table

# Ids of a segment: three ways, some of which are not in the network. A way has two edges of the nation graph.
IDS = Q.E + """,
nw AS (SELECT (count(*) + 1) // 2 AS n FROM e),
ix AS (SELECT DISTINCT seg, unnest([seg % n, (seg * 7 + 3) % n, seg * 13 % (n + 40)]) AS way FROM (SELECT DISTINCT user_id AS seg FROM events), nw),
ik AS (SELECT seg, count(*) AS n_ids FROM ix GROUP BY 1 HAVING count(*) > 1),
im AS MATERIALIZED (SELECT ix.seg, way, u, v, least(u, v) || '|' || greatest(u, v) AS gk FROM ix JOIN ik USING (seg) JOIN e ON e.edge_ord // 2 = way),
ir(seg, a, b) AS (SELECT seg, u, u FROM im UNION SELECT seg, v, v FROM im UNION SELECT r.seg, a, CASE WHEN m.u = r.b THEN m.v ELSE m.u END FROM ir r JOIN im m ON m.seg = r.seg AND (m.u = r.b OR m.v = r.b)),
ic AS (SELECT seg, c, count(*) AS n FROM (SELECT seg, a, min(b) AS c FROM ir GROUP BY 1, 2) GROUP BY 1, 2),
ip AS (SELECT seg, count(*) AS components, CAST(sum(n) AS BIGINT) AS nodes, max(n) AS largest FROM ic GROUP BY 1),
ig AS (SELECT seg, count(DISTINCT way) AS n_found, count(DISTINCT (way, u, v, gk)) AS n_edges, count(DISTINCT gk) AS pieces FROM im GROUP BY 1),
io AS (SELECT ik.seg, n_ids, coalesce(n_found, 0) AS n_found, coalesce(n_edges, 0) AS n_edges, coalesce(components, 0) AS components, coalesce(nodes, 0) AS nodes, coalesce(largest, 0) AS largest, coalesce(pieces, 0) AS pieces FROM ik LEFT JOIN ig USING (seg) LEFT JOIN ip USING (seg))"""


@query(IDS + " SELECT *, CASE WHEN n_found < n_ids THEN 'absent' WHEN components <> 1 THEN 'disconnected' WHEN pieces = 1 THEN 'connected' ELSE 'parts' END AS relation FROM io")
def multi_id_relations(spark, sf_dir):
    e = Q.edges(spark, sf_dir)
    n = F.broadcast(e.agg(F.expr("(count(*) + 1) div 2").alias("n")))
    seg = F.col("seg")
    ids = F.array(seg % F.col("n"), (seg * 7 + 3) % F.col("n"), seg * 13 % (F.col("n") + 40))
    segments = table(spark, sf_dir, "events").select(F.col("user_id").alias("seg")).distinct().join(n).select("seg", ids.alias("ids"))
    ways = e.select(F.expr("cast(edge_ord div 2 as long)").alias("way"), "u", "v", F.concat(F.least("u", "v"), F.lit("|"), F.greatest("u", "v")).alias("geom_key"))
    return M.id_relations(segments, ways)


# Streets of thirty lines each, sixty metres apart; some lines run a metre and a half beside the others.
LINES = """WITH k AS (SELECT c_custkey AS k FROM customer),
l AS MATERIALIZED (SELECT k, 25.0 * (k % 30) AS x, 60.0 * (k // 30) + CASE WHEN k % 4 = 2 THEN 1.5 ELSE 0 END AS y, 30.0 + 10 * (k % 5) AS w, 20.0 + k % 3 * 5 AS h FROM k),
p AS (SELECT a.k AS a, b.k AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS separation, a.w + a.h AS length_a, b.w + b.h AS length_b,
CASE WHEN a.y = b.y THEN greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) ELSE 0 END + CASE WHEN a.x + a.w = b.x + b.w THEN greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) ELSE 0 END AS overlap_m,
[[a.x, a.x + a.w, a.y, a.y], [a.x + a.w, a.x + a.w, a.y, a.y + a.h]] AS la, [[b.x, b.x + b.w, b.y, b.y], [b.x + b.w, b.x + b.w, b.y, b.y + b.h]] AS lb
FROM l a JOIN l b ON b.k > a.k AND b.k <= a.k + 150 WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 10000),
g AS (SELECT a, b, separation, length_a, length_b, overlap_m, list_min(list_transform(la, lambda s: list_min(list_transform(lb, lambda t: sqrt(greatest(0, s[1] - t[2], t[1] - s[2]) ** 2 + greatest(0, s[3] - t[4], t[3] - s[4]) ** 2))))) AS gap FROM p)
SELECT a, b, round(separation, 4) AS separation, round(overlap_m, 2) AS overlap_m, CASE WHEN gap <= 2 THEN round(gap, 4) END AS gap_m,
CASE WHEN overlap_m >= 0.8 * least(length_a, length_b) AND separation <= 10 THEN 'duplicate' WHEN overlap_m >= greatest(5, 0.1 * least(length_a, length_b)) THEN 'overlapping' WHEN gap <= 2 THEN 'adjacent' ELSE 'unrelated' END AS kind FROM g"""


def streets(spark, sf_dir):
    """line, x, y, pts: a way east and then north for each customer."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("line"), (25.0 * (k % 30)).alias("x"), (60.0 * F.expr("c_custkey div 30") + F.when(k % 4 == 2, 1.5).otherwise(0.0)).alias("y"), (30.0 + 10 * (k % 5)).alias("w"), (20.0 + k % 3 * 5).alias("h"))
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    return c.select("line", "x", "y", F.array(at(x, y), at(x + F.col("w"), y), at(x + F.col("w"), y + F.col("h"))).alias("pts"))


@query(LINES)
def line_overlaps(spark, sf_dir):
    """Lines of segments up to 100 m apart: metres that they share, their distance, and what that makes them."""
    lines = streets(spark, sf_dir)
    pairs = SP.near_points(lines, 100.0, "line")
    o = SP.overlaps(pairs, lines).join(pairs.withColumnRenamed("distance", "separation"), ["a", "b"])
    o = o.select("a", "b", "separation", "overlap_m", "gap_m", SP.overlap_class("separation", F.lit(False)).alias("kind"))
    return rounded(rounded(o, "separation", "gap_m"), "overlap_m", places=2)


# The series of the transverse Mercator projection, spelled out.
_T, _C, _A = "pow(tan(p), 2)", "0.006739496742276434 * pow(cos(p), 2)", "(radians(lon - 87.0) * cos(p))"
_N = "(6378137.0 / sqrt(1 - 0.0066943799901413165 * pow(sin(p), 2)))"
UTM = f"""WITH g AS (SELECT c_custkey AS node, 20.0 + c_custkey % 997 * 0.001 AS lat, 85.0 + c_custkey % 1009 * 0.001 AS lon FROM customer),
q AS (SELECT *, radians(lat) AS p FROM g),
m AS (SELECT *, 6378137.0 * (0.9983242984527954 * p - 0.002514607060518705 * sin(2 * p) + 2.6390465943376213e-06 * sin(4 * p) - 3.4180460865957878e-09 * sin(6 * p)) AS m FROM q)
SELECT node, round(500000 + 0.9996 * {_N} * ({_A} + (1 - {_T} + {_C}) * pow({_A}, 3) / 6 + (5 - 18 * {_T} + pow({_T}, 2) + 72 * {_C} - 58 * 0.006739496742276434) * pow({_A}, 5) / 120), 2) AS easting,
round(0.9996 * (m + {_N} * tan(p) * (pow({_A}, 2) / 2 + (5 - {_T} + 9 * {_C} + 4 * pow({_C}, 2)) * pow({_A}, 4) / 24 + (61 - 58 * {_T} + pow({_T}, 2) + 600 * {_C} - 330 * 0.006739496742276434) * pow({_A}, 6) / 720)), 2) AS northing FROM m"""


@query(UTM)
def projected_nodes(spark, sf_dir):
    k = F.col("c_custkey")
    n = table(spark, sf_dir, "customer").select(k.alias("node"), *M.utm(20.0 + k % 997 * 0.001, 85.0 + k % 1009 * 0.001)).toDF("node", "easting", "northing")
    return rounded(n, "easting", "northing", places=2)


GEO = Q.E + ", nx AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS node, 100.0 * n_nationkey AS x, 10.0 * (n_nationkey * 7 % 25) AS y FROM nation)"


def shapes(spark, sf_dir):
    """Edges with a geometry of their own, or none: every third bends, and its way back bends alike only for even sums."""
    e = Q.edges(spark, sf_dir)
    n = table(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("node"), (100.0 * F.col("n_nationkey")).alias("x"), (10.0 * (F.col("n_nationkey") * 7 % 25)).alias("y"))
    u, v = F.col("u").cast("int"), F.col("v").cast("int")
    low, high = F.least(u, v), F.greatest(u, v)
    side = F.when((low + high) % 2 == 0, low).otherwise(u)
    point = lambda i: F.concat((100 * i).cast("string"), F.lit(".0 "), (10 * (i * 7 % 25)).cast("string"), F.lit(".0"))
    bend = F.concat((50 * (u + v)).cast("string"), F.lit(".0 "), (5 + side).cast("string"), F.lit(".0"))
    line = F.concat(F.lit("LINESTRING ("), point(u), F.lit(", "), bend, F.lit(", "), point(v), F.lit(")"))
    return e.withColumn("geometry", F.when((low + high) % 3 == 0, line)), n


@query(GEO + " SELECT u, v, key, CASE WHEN (CAST(u AS INTEGER) + CAST(v AS INTEGER)) % 3 = 0 THEN 3 ELSE 2 END AS n_points, round(CASE WHEN (CAST(u AS INTEGER) + CAST(v AS INTEGER)) % 3 = 0 THEN sqrt((b.x0 - a.x) ** 2 + (b.y0 - a.y) ** 2) + sqrt((c.x - b.x0) ** 2 + (c.y - b.y0) ** 2) ELSE sqrt((c.x - a.x) ** 2 + (c.y - a.y) ** 2) END, 4) AS length FROM e JOIN nx a ON a.node = u JOIN nx c ON c.node = v, LATERAL (SELECT 50.0 * (CAST(u AS INTEGER) + CAST(v AS INTEGER)) AS x0, 5.0 + CASE WHEN (CAST(u AS INTEGER) + CAST(v AS INTEGER)) % 2 = 0 THEN least(CAST(u AS INTEGER), CAST(v AS INTEGER)) ELSE CAST(u AS INTEGER) END AS y0) b")
def edge_coordinates(spark, sf_dir):
    """The points of each edge: its geometry's, or the straight line between its ends."""
    e, n = shapes(spark, sf_dir)
    p = M.edge_points(e, n)
    return rounded(p.select("u", "v", "key", F.size("pts").alias("n_points"), M.line_length("pts").alias("length")), "length")


@query(GEO + ", k AS (SELECT DISTINCT u, v, CAST(u AS INTEGER) + CAST(v AS INTEGER) AS s FROM e) SELECT e.u, e.v, e.key FROM e JOIN k ON k.u = e.v AND k.v = e.u WHERE s % 3 <> 0 OR s % 2 = 0")
def reciprocal_edges(spark, sf_dir):
    """Edges with one the other way along the same line: the key is of the geometry, not of the ends."""
    e, n = shapes(spark, sf_dir)
    pts = M.edge_points(e, n)
    return M.reciprocal(pts.withColumn("geom_key", M.canonical_key(F.col("pts")))).select("u", "v", "key")
