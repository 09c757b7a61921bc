"""The library under SQL names: scalar and table functions written in SQL, so that they are inlined and optimised like any query.

Table functions read the views that `register_tables` makes: network_edges (scenario, u, v,
key, weight, ...) and route_legs (route, step, v, weight, length_m).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FUNCTIONS = {
    "travel_time_s(length_m DOUBLE, kmh DOUBLE) RETURNS DOUBLE": "greatest(coalesce(length_m, 10.0D) / (greatest(kmh, 3.0D) / 3.6D), 0.001D)",
    "haversine_m(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": "2 * 6371000.0D * asin(sqrt(least(1.0D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))",
    "speed_class(kmh DOUBLE) RETURNS STRING": "CASE WHEN kmh >= 35 THEN 'free' WHEN kmh >= 20 THEN 'moderate' ELSE 'congested' END",
    "set_jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN size(array_union(a, b)) = 0 THEN 1.0D ELSE size(array_intersect(a, b)) / cast(size(array_union(a, b)) as double) END",
    "gate_open(remaining DOUBLE, best DOUBLE, least_s DOUBLE, least_pct DOUBLE) RETURNS BOOLEAN": "remaining - best >= least_s AND coalesce(try_divide(100 * (remaining - best), remaining), 0) >= least_pct",
}

TABLE_FUNCTIONS = {
    # The best edges on from a node.
    "edges_from(node STRING, most INT) RETURNS TABLE (v STRING, key INT, weight DOUBLE, place INT)": "SELECT v, key, weight, place FROM (SELECT u, v, key, weight, row_number() OVER (PARTITION BY u ORDER BY weight, v, key) AS place FROM network_edges) WHERE u = edges_from.node AND place <= most",
    # Nodes within a number of edges, and how many they take: hop by hop, each node as often as ways reach it.
    "nodes_within(start STRING, most INT) RETURNS TABLE (node STRING, hops INT)": "WITH RECURSIVE r(node, hops) AS (SELECT start, 0 UNION ALL SELECT DISTINCT e.v, r.hops + 1 FROM r JOIN network_edges e ON e.u = r.node WHERE r.hops < most) SELECT node, min(hops) FROM r GROUP BY node",
    # A route's progress.
    "route_timeline(name STRING) RETURNS TABLE (step INT, node STRING, elapsed_s DOUBLE, distance_m DOUBLE, progress_pct DOUBLE)": "SELECT step, v, sum(weight) OVER w, sum(length_m) OVER w, 100.0D * (step + 1) / count(*) OVER (PARTITION BY route) FROM route_legs WHERE route = name WINDOW w AS (PARTITION BY route ORDER BY step)",
}


def register(spark: SparkSession) -> None:
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


def register_tables(edges: DataFrame, legs: DataFrame) -> None:
    """Views of a network and of routes' legs, and the table functions over them."""
    edges.createOrReplaceTempView("network_edges")
    legs.createOrReplaceTempView("route_legs")
    for signature, body in TABLE_FUNCTIONS.items():
        edges.sparkSession.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
