"""Metrics of sessions that each have a graph of their own, and user hooks.

The graph of a session is that of its customer's nation: the last digits of the
nation's customers, joined by steps of a length that the nation gives.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from burrow.operators import hooks
from burrow.operators import locate as L
from burrow.operators import metrics as M
from burrow.plans.frame_queries import SPEC, rounded
from burrow.plans.path_queries import ERROR, PURCHASE, paths_sql
from burrow.plans.place_queries import _points, places_sql
from burrow.plans.registry import query
from burrow.plans.standins import frames, regions, sessions, table, with_ctes


def session_graphs(spark, sf_dir):
    """(edges of all graphs, the graph of each session)."""
    key, step = F.col("c_custkey"), 1 + F.col("c_nationkey") % 3
    customers = table(spark, sf_dir, "customer")
    graph = F.concat(F.lit("n"), F.col("c_nationkey")).alias("graph_id")
    digit = key % 10
    ring = customers.select(graph, digit.alias("u"), ((digit + step) % 10).alias("v"))
    chords = customers.where(digit.isin(0, 4)).select(graph, digit.alias("u"), (digit + 1).alias("v"))
    edges = ring.union(chords).distinct().withColumns({c: F.col(c).cast("string") for c in "uv"})
    return edges, customers.select(key.alias("session_id"), graph)


_GRAPHS = """graphs AS (SELECT c_custkey AS session_id, 'n' || c_nationkey AS graph_id FROM customer),
links AS (
  SELECT 'n' || c_nationkey AS graph_id, CAST(c_custkey % 10 AS VARCHAR) AS u, CAST((c_custkey % 10 + 1 + c_nationkey % 3) % 10 AS VARCHAR) AS v FROM customer
  UNION SELECT 'n' || c_nationkey, CAST(c_custkey % 10 AS VARCHAR), CAST(c_custkey % 10 + 1 AS VARCHAR) FROM customer WHERE c_custkey % 10 IN (0, 4)),
ways AS (SELECT graph_id, u, v FROM links UNION SELECT graph_id, v, u FROM links),
spots AS (SELECT graph_id, count(DISTINCT u) AS nodes FROM ways GROUP BY graph_id)"""

# Breadth first from 0, then back from 3 over the smallest parents.
_ROUTES = """reach(graph_id, node, d) AS (
  SELECT DISTINCT graph_id, u, 0 FROM ways WHERE u = '0'
  UNION SELECT r.graph_id, w.v, r.d + 1 FROM reach r JOIN ways w ON w.graph_id = r.graph_id AND w.u = r.node WHERE r.d < 10),
dist AS (SELECT graph_id, node, min(d) AS d FROM reach GROUP BY graph_id, node),
parent AS (SELECT b.graph_id, b.node, min(a.node) AS u FROM dist a JOIN ways w ON w.graph_id = a.graph_id AND w.u = a.node
  JOIN dist b ON b.graph_id = a.graph_id AND b.node = w.v AND b.d = a.d + 1 GROUP BY b.graph_id, b.node),
back(graph_id, node, d) AS (
  SELECT graph_id, node, d FROM dist WHERE node = '3'
  UNION ALL SELECT k.graph_id, p.u, k.d - 1 FROM back k JOIN parent p ON p.graph_id = k.graph_id AND p.node = k.node WHERE k.d > 0),
both_ends AS (SELECT graph_id FROM ways WHERE u IN ('0', '3') GROUP BY graph_id HAVING count(DISTINCT u) = 2),
routes AS (SELECT g.session_id, coalesce(r.route, CAST([] AS VARCHAR[])) AS route FROM graphs g JOIN both_ends USING (graph_id)
  LEFT JOIN (SELECT graph_id, list(node ORDER BY d) AS route FROM back GROUP BY graph_id) r USING (graph_id))"""

_FOLLOWED = """inside AS (
  SELECT p.session_id, p.path_id, f.frame_number, CAST(f.node AS VARCHAR) AS value,
    lag(f.node) OVER (PARTITION BY p.session_id, p.path_id ORDER BY f.frame_number) AS pv, f.node
  FROM paths p JOIN frames f ON f.session_id = p.session_id AND f.frame_number BETWEEN p.start_frame AND p.end_frame),
steps AS (SELECT session_id, path_id, value, row_number() OVER (PARTITION BY session_id, path_id ORDER BY frame_number) AS pos
  FROM inside WHERE pv IS NULL OR pv <> node),
fold(session_id, path_id, pos, progress, route) AS (
  SELECT p.session_id, p.path_id, CAST(0 AS BIGINT), 0, r.route FROM paths p JOIN routes r ON r.session_id = p.session_id
  UNION ALL
  SELECT f.session_id, f.path_id, s.pos, CASE WHEN f.progress < len(f.route) - 1 AND s.value = f.route[f.progress + 2] THEN f.progress + 1 ELSE f.progress END, f.route
  FROM fold f JOIN steps s ON s.session_id = f.session_id AND s.path_id = f.path_id AND s.pos = f.pos + 1),
scored AS (SELECT session_id, path_id, max(progress) AS progress, greatest(max(pos) - 1, 0) AS actual, greatest(max(len(route)) - 1, 0) AS optimal FROM fold GROUP BY session_id, path_id)"""

_BATTERY = f"""{_GRAPHS},
{_ROUTES},
{_FOLLOWED},
counts AS (SELECT session_id, path_id, count(DISTINCT node) AS n FROM inside GROUP BY session_id, path_id),
battery AS (
  SELECT session_id, 'share' AS metric, path_id, coalesce(n / nodes * 100, 0.0) AS value
  FROM counts LEFT JOIN graphs USING (session_id) LEFT JOIN spots USING (graph_id)
  UNION ALL SELECT session_id, 'explored', NULL, coalesce(n / nodes * 100, n) FROM (SELECT session_id, count(DISTINCT node) AS n FROM frames GROUP BY session_id)
    LEFT JOIN graphs USING (session_id) LEFT JOIN spots USING (graph_id)
  UNION ALL SELECT session_id, 'progress', path_id, progress FROM scored
  UNION ALL SELECT session_id, 'efficiency', path_id, CASE WHEN actual > 0 THEN optimal / actual * 100 ELSE 0.0 END FROM scored)"""


def _battery(spark, sf_dir):
    edges, graphs = session_graphs(spark, sf_dir)
    context = M.Context(frames(spark, sf_dir), sessions(spark, sf_dir), edges=edges, graphs=graphs)
    route = SPEC | {"path_column": "node", "start_node": 0, "end_node": 3}
    return M.battery(
        context,
        {
            "share": ("num_values_in_path", SPEC | {"count_column": "node", "mode": "percentage"}),
            "explored": ("exploration_percentage", {"location_column": "node"}),
            "progress": ("shortest_path_efficiency", route | {"measure": "progress"}),
            "efficiency": ("shortest_path_efficiency", route),
        },
    )


@query("m3_battery_of_session_graphs", paths_sql(
    ERROR, PURCHASE, "SELECT session_id, metric, path_id, round(value, 6) AS value FROM battery", extra=_BATTERY))
def m3_battery_of_session_graphs(spark, sf_dir):
    return rounded(_battery(spark, sf_dir), 6, "value")


# A cross-session metric of one's own, registered as a user would.
def best_sessions(metrics, metric_name: str, least: float):
    """Sessions whose mean of a metric reaches ``least``, with that mean."""
    of_session = metrics.where(F.col("metric") == metric_name).groupBy("session_id").agg(F.avg("value").alias("mean_value"))
    return of_session.where(F.col("mean_value") >= least)


M.cross_session_metric("best_sessions")(best_sessions)


@query("u2_cross_session_metrics", paths_sql(ERROR, PURCHASE, """
SELECT 'best' AS result, session_id, NULL AS pos, round(avg(value), 6) AS value FROM battery WHERE metric = 'efficiency' GROUP BY session_id HAVING avg(value) >= 40
UNION ALL SELECT 'learned', session_id, pos, round(value, 6) FROM battery JOIN (
  SELECT session_id, row_number() OVER (ORDER BY session_id) - 1 AS pos FROM (SELECT DISTINCT session_id FROM battery WHERE metric = 'efficiency')) USING (session_id)
WHERE metric = 'efficiency'""", extra=_BATTERY))
def u2_cross_session_metrics(spark, sf_dir):
    wanted = {
        "best": ("best_sessions", {"metric_name": "efficiency", "least": 40.0}),
        "learned": ("learning_progression", {"metric_name": "efficiency"}),
    }
    found = M.cross_session(_battery(spark, sf_dir), wanted)
    best = found["best"].select(F.lit("best").alias("result"), "session_id", F.lit(None).cast("bigint").alias("pos"), F.col("mean_value").alias("value"))
    learned = found["learned"].select(F.lit("learned").alias("result"), "session_id", F.col("pos").cast("bigint").alias("pos"), "value")
    return rounded(best.unionByName(learned), 6, "value")


# Data sources of one's own, one of them with a join.
@hooks.data_source("reach", adds=["reach"])
def reach(rows, weight):
    return rows.withColumn("reach", F.col("x") + weight * F.col("y"))


@hooks.data_source("below_top", adds=["below_top"])
def below_top(rows):
    tops = rows.groupBy("session_id").agg(F.max("x").alias("_top"))
    return rows.join(tops, "session_id").withColumn("below_top", F.col("_top") - F.col("x")).drop("_top")


@query("u3_data_sources", with_ctes("frames") + """
SELECT session_id, frame_number, round(x + 2 * y, 6) AS reach, round(max(x) OVER (PARTITION BY session_id) - x, 6) AS below_top FROM frames""")
def u3_data_sources(spark, sf_dir):
    out = hooks.with_sources(frames(spark, sf_dir), [("reach", {"weight": 2}), ("below_top", {})])
    return rounded(out.select("session_id", "frame_number", "reach", "below_top"), 6, "reach", "below_top")


# One region for each map, so that no point can lie in two.
@query("r8_raise_error", places_sql("""
SELECT p.session_id, p.frame_number, p.bodypart, h.node_id AS graph_node, h.u AS graph_u, h.v AS graph_v FROM pose p
LEFT JOIN (SELECT * FROM hits WHERE ord < (SELECT count(*) FROM supplier)) h
  ON h.session_id = p.session_id AND h.frame_number = p.frame_number AND h.bodypart = p.bodypart"""))
def r8_raise_error(spark, sf_dir):
    n = table(spark, sf_dir, "supplier").select(F.count("*")).scalar()
    lone = regions(spark, sf_dir).where(F.col("ord") < n)
    keys = ["session_id", "frame_number", "bodypart"]
    return L.located(_points(spark, sf_dir), lone, keys, "raise_error").select(*keys, "graph_node", "graph_u", "graph_v")
