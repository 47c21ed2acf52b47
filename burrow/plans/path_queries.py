"""Paths, aggregates inside paths, session metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from burrow.operators import metrics as M
from burrow.operators import paths as P
from burrow.plans.registry import query
from burrow.plans.standins import frames, sessions, table, with_ctes

# Next start, next end and last end seen from every frame; the loop below then
# replays the greedy search one path at a time.
_SEEN = """seen AS (
  SELECT *, min(CASE WHEN is_s THEN frame_number END) OVER later AS ns,
         min(CASE WHEN is_e THEN frame_number END) OVER later AS ne,
         max(CASE WHEN is_e THEN frame_number END) OVER so_far AS le,
         max(CASE WHEN is_e THEN frame_number END) OVER (PARTITION BY session_id) AS last_e
  FROM (SELECT session_id, frame_number, {s} AS is_s, {e} AS is_e FROM frames)
  WINDOW later AS (PARTITION BY session_id ORDER BY frame_number ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
         so_far AS (PARTITION BY session_id ORDER BY frame_number ROWS UNBOUNDED PRECEDING))"""

_FIRST = """{ctes},
heads AS (SELECT session_id, min(frame_number) AS s FROM seen WHERE is_s GROUP BY session_id),
paths(session_id, path_id, start_frame, end_frame) AS (
  SELECT h.session_id, CAST(0 AS BIGINT), h.s, n.ne
  FROM heads h JOIN seen n ON n.session_id = h.session_id AND n.frame_number = h.s WHERE n.ne IS NOT NULL
  UNION ALL
  SELECT p.session_id, p.path_id + 1, a.ns, b.ne
  FROM paths p JOIN seen a ON a.session_id = p.session_id AND a.frame_number = p.end_frame
  JOIN seen b ON b.session_id = p.session_id AND b.frame_number = a.ns WHERE b.ne IS NOT NULL)"""

_LAST = """{ctes},
ends AS (
  SELECT a.session_id, a.frame_number,
         CASE WHEN a.ns IS NULL THEN CASE WHEN a.last_e > a.frame_number THEN a.last_e END
              WHEN b.le > a.frame_number THEN b.le ELSE a.ne END AS e
  FROM seen a LEFT JOIN seen b ON b.session_id = a.session_id AND b.frame_number = a.ns - 1 WHERE a.is_s),
heads AS (SELECT session_id, min(frame_number) AS s FROM seen WHERE is_s GROUP BY session_id),
paths(session_id, path_id, start_frame, end_frame) AS (
  SELECT h.session_id, CAST(0 AS BIGINT), h.s, n.e
  FROM heads h JOIN ends n ON n.session_id = h.session_id AND n.frame_number = h.s WHERE n.e IS NOT NULL
  UNION ALL
  SELECT p.session_id, p.path_id + 1, a.ns, b.e
  FROM paths p JOIN seen a ON a.session_id = p.session_id AND a.frame_number = p.end_frame
  JOIN ends b ON b.session_id = p.session_id AND b.frame_number = a.ns WHERE b.e IS NOT NULL)"""


def paths_sql(s: str, e: str, tail: str, *, last: bool = False, ctes=("frames",), extra: str = "") -> str:
    head = with_ctes(*ctes, recursive=True, extra=_SEEN.format(s=s, e=e)).rstrip()
    body = (_LAST if last else _FIRST).format(ctes=head)
    return body + (",\n" + extra if extra else "") + "\n" + tail


ERROR, PURCHASE = "state = 'error'", "state = 'purchase'"
_ROWS = "SELECT session_id, path_id, start_frame, end_frame FROM paths"


def _error_to_purchase(spark, sf_dir, **args):
    return P.transitions(frames(spark, sf_dir), "state", "error", "state", "purchase", **args)


@query("t1_masks", with_ctes("frames") + """
SELECT session_id, frame_number, state = 'error' AS at_start, node = 3 AS at_end FROM frames
WHERE state = 'error' OR node = 3""")
def t1_masks(spark, sf_dir):
    start, end = P.matches("state", "error"), P.matches("node", 3)
    return frames(spark, sf_dir).where(start | end).select(
        "session_id", "frame_number", start.alias("at_start"), end.alias("at_end")
    )


@query("t2_transitions", paths_sql(ERROR, PURCHASE, _ROWS))
def t2_transitions(spark, sf_dir):
    return _error_to_purchase(spark, sf_dir)


@query("t2_transitions_overlap", paths_sql("node = 3", "state = 'view'", _ROWS))
def t2_transitions_overlap(spark, sf_dir):
    return P.transitions(frames(spark, sf_dir), "node", 3, "state", "view")


@query("t3_last_end", paths_sql(ERROR, PURCHASE, _ROWS, last=True))
def t3_last_end(spark, sf_dir):
    return _error_to_purchase(spark, sf_dir, first_end=False)


@query("t3_last_end_overlap", paths_sql("node = 3", "state = 'view'", _ROWS, last=True))
def t3_last_end_overlap(spark, sf_dir):
    return P.transitions(frames(spark, sf_dir), "node", 3, "state", "view", first_end=False)


@query("t4_length_filter", paths_sql(ERROR, PURCHASE, _ROWS + " WHERE end_frame - start_frame BETWEEN 2 AND 8"))
def t4_length_filter(spark, sf_dir):
    return _error_to_purchase(spark, sf_dir, min_length=2, max_length=8)


_IN = "frames f JOIN paths p ON f.session_id = p.session_id AND f.frame_number BETWEEN p.start_frame AND p.end_frame"
_BY = "GROUP BY p.session_id, p.path_id, p.start_frame, p.end_frame"
_P = "p.session_id, p.path_id, p.start_frame, p.end_frame"


@query("t5_distinct_filter", paths_sql(ERROR, PURCHASE, f"SELECT {_P} FROM {_IN} {_BY} HAVING count(DISTINCT f.node) >= 3"))
def t5_distinct_filter(spark, sf_dir):
    return _error_to_purchase(spark, sf_dir, min_distinct={"node": 3})


# A column with gaps: nodes 7 to 9 read as missing.
_GAPS = "CASE WHEN f.node < 7 THEN f.node END"


def _gappy(spark, sf_dir):
    node = F.when(F.col("node") < 7, F.col("node"))
    return frames(spark, sf_dir).withColumn("node", node)


@query("p1_distinct_in_path", paths_sql(
    ERROR, PURCHASE, f"SELECT {_P}, count(DISTINCT {_GAPS}) AS distinct_values FROM {_IN} {_BY}"))
def p1_distinct_in_path(spark, sf_dir):
    return P.distinct_in_path(_gappy(spark, sf_dir), _error_to_purchase(spark, sf_dir), "node")


_KEPT = f"""vals AS (
  SELECT p.session_id, p.path_id, p.start_frame, p.end_frame, f.frame_number, {_GAPS} AS v FROM {_IN} WHERE f.node < 7),
runs AS (SELECT *, lag(v) OVER (PARTITION BY session_id, path_id ORDER BY frame_number) AS pv FROM vals)"""


@query("p2_changes_in_path", paths_sql(ERROR, PURCHASE, """
SELECT p.session_id, p.path_id, p.start_frame, p.end_frame,
       coalesce(count(*) FILTER (WHERE r.pv IS NOT NULL AND r.v <> r.pv), 0) AS value_changes
FROM paths p LEFT JOIN runs r ON r.session_id = p.session_id AND r.path_id = p.path_id
GROUP BY p.session_id, p.path_id, p.start_frame, p.end_frame""", extra=_KEPT))
def p2_changes_in_path(spark, sf_dir):
    return P.changes_in_path(_gappy(spark, sf_dir), _error_to_purchase(spark, sf_dir), "node")


@query("p3_path_sequence", paths_sql(ERROR, PURCHASE, """
SELECT session_id, path_id,
       row_number() OVER (PARTITION BY session_id, path_id ORDER BY frame_number) - 1 AS pos, frame_number, v AS value
FROM runs WHERE pv IS NULL OR pv <> v""", extra=_KEPT))
def p3_path_sequence(spark, sf_dir):
    return P.sequence_in_path(_gappy(spark, sf_dir), _error_to_purchase(spark, sf_dir), "node")


@query("p3_path_sequence_all", paths_sql(ERROR, PURCHASE, """
SELECT session_id, path_id,
       row_number() OVER (PARTITION BY session_id, path_id ORDER BY frame_number) - 1 AS pos, frame_number, v AS value
FROM runs""", extra=_KEPT))
def p3_path_sequence_all(spark, sf_dir):
    return P.sequence_in_path(
        _gappy(spark, sf_dir), _error_to_purchase(spark, sf_dir), "node", collapse=False
    )


_MOVES = f"""moves AS (
  SELECT p.session_id, p.path_id, p.start_frame, p.end_frame,
         coalesce(sum(CASE WHEN f.frame_number > p.start_frame THEN sqrt((f.gx - f.px) ** 2 + (f.gy - f.py) ** 2) END), 0) AS distance
  FROM (SELECT *, lag(gx) OVER w AS px, lag(gy) OVER w AS py
        FROM (SELECT *, CASE WHEN node <> 5 THEN x END AS gx, CASE WHEN node <> 5 THEN y END AS gy FROM frames)
        WINDOW w AS (PARTITION BY session_id ORDER BY frame_number)) f
  JOIN paths p ON f.session_id = p.session_id AND f.frame_number BETWEEN p.start_frame AND p.end_frame {_BY})"""


def _holes(spark, sf_dir):
    seen = F.col("node") != 5
    return frames(spark, sf_dir).withColumns(
        {"x": F.when(seen, F.col("x")), "y": F.when(seen, F.col("y"))}
    )


@query("p4_path_distance", paths_sql(
    ERROR, PURCHASE,
    "SELECT session_id, path_id, start_frame, end_frame, round(distance, 5) AS distance FROM moves", extra=_MOVES))
def p4_path_distance(spark, sf_dir):
    moved = P.distance_in_path(_holes(spark, sf_dir), _error_to_purchase(spark, sf_dir))
    return moved.withColumn("distance", F.round("distance", 5))


@query("f12_pixel_scale", paths_sql(
    ERROR, PURCHASE,
    "SELECT session_id, path_id, start_frame, end_frame, round(distance * 0.25, 5) AS distance FROM moves", extra=_MOVES))
def f12_pixel_scale(spark, sf_dir):
    moved = P.distance_in_path(
        _holes(spark, sf_dir), _error_to_purchase(spark, sf_dir), pixel_to_meter=0.25
    )
    return moved.withColumn("distance", F.round("distance", 5))


@query("p5_time_a_to_b", paths_sql(
    ERROR, PURCHASE,
    """SELECT p.session_id, p.path_id, p.start_frame, p.end_frame,
              round((p.end_frame - p.start_frame) / coalesce(s.fps, 30.0), 6) AS seconds
       FROM paths p LEFT JOIN sessions s ON s.session_id = p.session_id""", ctes=("frames", "sessions")))
def p5_time_a_to_b(spark, sf_dir):
    timed = P.time_in_path(_error_to_purchase(spark, sf_dir), sessions(spark, sf_dir))
    return timed.withColumn("seconds", F.round("seconds", 6))


@query("p6_velocity_a_to_b", paths_sql(
    ERROR, PURCHASE,
    """SELECT m.session_id, m.path_id,
              round(m.distance * coalesce(s.pixel_to_meter, 1.0) * coalesce(s.fps, 30.0) / (m.end_frame - m.start_frame), 5) AS velocity
       FROM moves m LEFT JOIN sessions s ON s.session_id = m.session_id""", ctes=("frames", "sessions"), extra=_MOVES))
def p6_velocity_a_to_b(spark, sf_dir):
    fast = P.velocity_in_path(
        _holes(spark, sf_dir), _error_to_purchase(spark, sf_dir), sessions=sessions(spark, sf_dir)
    )
    return fast.select("session_id", "path_id", F.round("velocity", 5).alias("velocity"))


_COUNTS = f"counts AS (SELECT {_P}, count(DISTINCT {_GAPS}) AS n FROM {_IN} {_BY})"


def _share(spark, sf_dir, **args):
    out = P.values_in_path(
        _gappy(spark, sf_dir), _error_to_purchase(spark, sf_dir), "node", **args
    )
    return out.withColumn("value", F.round("value", 6))


@query("p7_unique_values", paths_sql(
    ERROR, PURCHASE, "SELECT session_id, path_id, start_frame, end_frame, CAST(n AS DOUBLE) AS value FROM counts", extra=_COUNTS))
def p7_unique_values(spark, sf_dir):
    return _share(spark, sf_dir, mode="unique")


@query("p7_share_of_graph", paths_sql(
    ERROR, PURCHASE, "SELECT session_id, path_id, start_frame, end_frame, round(n / 10 * 100, 6) AS value FROM counts", extra=_COUNTS))
def p7_share_of_graph(spark, sf_dir):
    return _share(spark, sf_dir, mode="percentage", graph_totals=(10, 15))


@query("p7_share_of_first_path", paths_sql(
    ERROR, PURCHASE,
    """SELECT session_id, path_id, start_frame, end_frame,
              CASE WHEN t > 0 THEN round(n / t * 100, 6) ELSE 0.0 END AS value
       FROM (SELECT *, first_value(n) OVER (PARTITION BY session_id ORDER BY start_frame) AS t FROM counts)""", extra=_COUNTS))
def p7_share_of_first_path(spark, sf_dir):
    return _share(spark, sf_dir, mode="percentage")
