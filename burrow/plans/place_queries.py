"""Regions, point location and map checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from burrow.functions import geometry as G
from burrow.operators import frames as FR
from burrow.operators import locate as L
from burrow.plans.frame_queries import _CAL, _MAPPED, _MASKED, _mapped, calibration, rounded
from burrow.plans.registry import query
from burrow.plans.standins import pose, regions, table, with_ctes


# Every point of a session with the regions of the same session that hold it.
def _hits(points: str) -> str:
    return f"""near AS MATERIALIZED (
  SELECT p.*, r.region_id, r.kind, r.ord, r.element_type, r.node_id, r.u, r.v, r.area, r.center_x, r.center_y, r.cx, r.cy, r.a, r.b, r.angle
  FROM {points} p JOIN regions r ON r.map_id = p.session_id AND p.x BETWEEN r.x0 - 1e-6 AND r.x1 + 1e-6 AND p.y BETWEEN r.y0 - 1e-6 AND r.y1 + 1e-6),
outlined AS MATERIALIZED (
  SELECT n.session_id, n.frame_number, n.bodypart, n.region_id
  FROM near n JOIN sides s ON s.region_id = n.region_id
  GROUP BY ALL HAVING count(*) FILTER (WHERE (s.y1 > n.y) <> (s.y2 > n.y) AND n.x < (s.x2 - s.x1) * (n.y - s.y1) / (s.y2 - s.y1) + s.x1) % 2 = 1
     OR bool_or((s.x2 - s.x1) * (n.y - s.y1) = (s.y2 - s.y1) * (n.x - s.x1) AND n.x BETWEEN least(s.x1, s.x2) AND greatest(s.x1, s.x2)
                AND n.y BETWEEN least(s.y1, s.y2) AND greatest(s.y1, s.y2))),
hits AS MATERIALIZED (
  SELECT * FROM near WHERE kind = 'rectangle' AND x BETWEEN cx AND cx + a AND y BETWEEN cy AND cy + b
     OR kind = 'circle' AND (x - cx) ** 2 + (y - cy) ** 2 <= a * a
     OR kind = 'ellipse' AND (((x - cx) * cos(angle) + (y - cy) * sin(angle)) / a) ** 2 + (((y - cy) * cos(angle) - (x - cx) * sin(angle)) / b) ** 2 <= 1
  UNION ALL SELECT n.* FROM near n SEMI JOIN outlined o ON o.session_id = n.session_id AND o.frame_number = n.frame_number
     AND o.bodypart = n.bodypart AND o.region_id = n.region_id)"""


def places_sql(tail: str, points: str = "pose", extra: str = "") -> str:
    head = with_ctes("pose", "regions", extra=extra) if extra else with_ctes("pose", "regions")
    return head.rstrip() + ",\n" + _hits(points) + "\n" + tail


def _points(spark, sf_dir):
    return pose(spark, sf_dir).withColumn("map_id", F.col("session_id"))


@query("r1_r2_r7_matching_regions", places_sql("SELECT session_id, frame_number, bodypart, region_id FROM hits"))
def r7_matchingregions(spark, sf_dir):
    found = L.matching_regions(_points(spark, sf_dir), regions(spark, sf_dir))
    return found.select("session_id", "frame_number", "bodypart", "region_id")


@query("r3_r4_bounds_area", with_ctes("regions") + """
SELECT region_id, kind, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1,
       round(center_x, 6) AS center_x, round(center_y, 6) AS center_y, round(area, 6) AS area FROM regions""")
def r3_bounds_area(spark, sf_dir):
    cols = ["x0", "y0", "x1", "y1", "center_x", "center_y", "area"]
    return rounded(regions(spark, sf_dir).select("region_id", "kind", *cols), 6, *cols)


_MEANS = """means AS (SELECT session_id, 0 AS frame_number, 'mean' AS bodypart, avg(x) AS x, avg(y) AS y FROM pose GROUP BY session_id)"""
_DISTANCE = """, away AS (
  SELECT r.map_id, r.region_id, r.kind, m.x, m.y, r.cx, r.cy, r.a, r.b, h.region_id IS NOT NULL AS within,
    (SELECT min(sqrt((m.x - (s.x1 + t * (s.x2 - s.x1))) ** 2 + (m.y - (s.y1 + t * (s.y2 - s.y1))) ** 2))
     FROM (SELECT *, least(greatest(((m.x - x1) * (x2 - x1) + (m.y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0), 1) AS t
           FROM sides WHERE sides.region_id = r.region_id) s) AS od
  FROM regions r JOIN means m ON m.session_id = r.map_id
  LEFT JOIN hits h ON h.region_id = r.region_id)
SELECT map_id, region_id, round(CASE WHEN kind = 'polygon' THEN od WHEN kind = 'circle' THEN abs(sqrt((x - cx) ** 2 + (y - cy) ** 2) - a)
  WHEN within THEN 0.0 WHEN kind = 'hexagon' THEN od
  WHEN kind = 'rectangle' THEN sqrt(greatest(0, cx - x, x - cx - a) ** 2 + greatest(0, cy - y, y - cy - b) ** 2)
  ELSE sqrt((x - cx) ** 2 + (y - cy) ** 2) END, 5) AS distance FROM away"""


@query("r5_distance_to_region", places_sql(_DISTANCE, "means", _MEANS))
def r5_distance_to_region(spark, sf_dir):
    means = pose(spark, sf_dir).groupBy("session_id").agg(F.avg("x").alias("px"), F.avg("y").alias("py"))
    both = regions(spark, sf_dir).join(means.withColumnRenamed("session_id", "map_id"), "map_id")
    far = both.select("map_id", "region_id", G.distance(F.col("px"), F.col("py")).alias("distance"))
    return rounded(far, 5, "distance")


# One grid per nation; its size and cells come from the nation's key.
_GRIDS = """grids AS (SELECT s_suppkey AS map_id, 4 + s_suppkey % 7 AS nr, 3 + s_suppkey % 5 AS nc, CAST(4.5 AS DOUBLE) AS cw, CAST(11.5 AS DOUBLE) AS ch,
  CAST(s_suppkey % 6 AS DOUBLE) AS ox, CAST(2.25 AS DOUBLE) AS oy FROM supplier),
cells AS (SELECT map_id, CAST(i AS INTEGER) AS "row", CAST(j AS INTEGER) AS col, ox, oy, cw, ch, nr, nc FROM grids, range(0, 10) a(i), range(0, 7) b(j) WHERE i < nr AND j < nc)"""


def grids(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("map_id"),
        (4 + k % 7).cast("int").alias("rows"),
        (3 + k % 5).cast("int").alias("cols"),
        F.lit(4.5).alias("cell_w"),
        F.lit(11.5).alias("cell_h"),
        (k % 6).cast("double").alias("origin_x"),
        F.lit(2.25).alias("origin_y"),
    )


@query("r6_grid_cells", f"WITH {_GRIDS}" + """
SELECT map_id, 'cell_' || "row" || '_' || col AS region_id, "row", col, ox + col * cw AS cx, oy + "row" * ch AS cy, cw AS a, ch AS b FROM cells""")
def r6_grid_cells(spark, sf_dir):
    return L.grid_cells(grids(spark, sf_dir)).drop("rows", "cols")


@query("r6_grid_neighbours", f"WITH {_GRIDS}" + """
SELECT p.map_id, p."row", p.col, q."row" AS to_row, q.col AS to_col FROM cells p JOIN cells q
ON q.map_id = p.map_id AND abs(q."row" - p."row") <= 1 AND abs(q.col - p.col) <= 1 AND (q."row" <> p."row" OR q.col <> p.col)""")
def r6_grid_neighbours(spark, sf_dir):
    return L.grid_neighbours(L.grid_cells(grids(spark, sf_dir)), 8)


@query("r6_cell_of_point", with_ctes("pose", extra=_GRIDS) + """
SELECT p.session_id, p.frame_number, p.bodypart, CASE WHEN c.map_id IS NOT NULL THEN 'cell_' || c."row" || '_' || c.col END AS cell
FROM pose p LEFT JOIN cells c ON c.map_id = p.session_id AND p.x >= ox + col * cw AND p.x < ox + (col + 1) * cw
  AND p.y >= oy + "row" * ch AND p.y < oy + ("row" + 1) * ch""")
def r6_cell_of_point(spark, sf_dir):
    found = L.grid_cell_of(_points(spark, sf_dir), grids(spark, sf_dir))
    return found.select("session_id", "frame_number", "bodypart", "cell")


def _located_sql(order: str, unmapped: str = "NULL", points: str = "pose", extra: str = "") -> str:
    """Every point with the hit whose list of ``order`` values is smallest."""
    return places_sql(
        f""", won AS MATERIALIZED (SELECT session_id, frame_number, bodypart,
    arg_min(struct_pack(node := node_id, u := u, v := v), row({order})) AS w FROM hits GROUP BY session_id, frame_number, bodypart)
SELECT p.session_id, p.frame_number, p.bodypart,
  CASE WHEN p.x IS NULL OR p.y IS NULL THEN NULL ELSE coalesce(w.w.node, {unmapped}) END AS graph_node, w.w.u AS graph_u, w.w.v AS graph_v
FROM {points} p LEFT JOIN won w ON w.session_id = p.session_id AND w.frame_number = p.frame_number AND w.bodypart = p.bodypart""",
        points,
        extra,
    )


_KIND = "CASE element_type WHEN 'node' THEN 0 ELSE 1 END"


def _place(spark, sf_dir, rule, **args):
    out = L.located(
        _points(spark, sf_dir), regions(spark, sf_dir), ["session_id", "frame_number", "bodypart"], rule, **args
    )
    return out.select("session_id", "frame_number", "bodypart", "graph_node", "graph_u", "graph_v")


@query("r8_node_priority", _located_sql(f"{_KIND}, ord"))
def r8_node_priority(spark, sf_dir):
    return _place(spark, sf_dir, "node_priority")


@query("r8_edge_priority", _located_sql(f"-({_KIND}), ord", "'nowhere'"))
def r8_edge_priority(spark, sf_dir):
    return _place(spark, sf_dir, "edge_priority", unmapped="nowhere")


@query("r8_smallest_region", _located_sql(f"area, {_KIND}, ord"))
def r8_smallest_region(spark, sf_dir):
    return _place(spark, sf_dir, "smallest_region")


@query("r8_largest_region", _located_sql(f"-area, {_KIND}, ord"))
def r8_largest_region(spark, sf_dir):
    return _place(spark, sf_dir, "largest_region")


@query("r8_nearest_center", _located_sql(f"sqrt((x - center_x) ** 2 + (y - center_y) ** 2), {_KIND}, ord"))
def r8_nearest_center(spark, sf_dir):
    return _place(spark, sf_dir, "nearest_center")


@query("r8_first_found", _located_sql(f"{_KIND}, ord"))
def r8_first_found(spark, sf_dir):
    return _place(spark, sf_dir, "first_found")


@query("u4_custom_rule", _located_sql("length(region_id), -ord"))
def u4_custom_rule(spark, sf_dir):
    return _place(spark, sf_dir, lambda x, y, r: [F.length(r["region_id"]), -r["ord"]])


_ON_MAP = "spots AS (SELECT session_id, frame_number, bodypart, map_x AS x, map_y AS y FROM mapped)"


@query("r9_graph_location", _located_sql(
    f"{_KIND}, ord", "'nowhere'", "spots", f"{_MASKED},\n{_CAL},\n{_MAPPED},\n{_ON_MAP}"))
def r9_graph_location(spark, sf_dir):
    masked = FR.mask_unlikely(pose(spark, sf_dir), 0.3, {"B": 0.55, "C": -1.0})
    out = L.located_pose(masked, calibration(spark, sf_dir), regions(spark, sf_dir), unmapped="nowhere")
    return out.select("session_id", "frame_number", "bodypart", "graph_node", "graph_u", "graph_v")


@query("r10_map_location", with_ctes("pose", extra=f"{_MASKED},\n{_CAL},\n{_MAPPED}") + """
SELECT session_id, frame_number, round(max(CASE WHEN bodypart = 'A' THEN map_x END), 5) AS A_map_x,
  round(max(CASE WHEN bodypart = 'A' THEN map_y END), 5) AS A_map_y, round(max(CASE WHEN bodypart = 'B' THEN map_x END), 5) AS B_map_x,
  round(max(CASE WHEN bodypart = 'B' THEN map_y END), 5) AS B_map_y
FROM mapped WHERE bodypart IN ('A', 'B') GROUP BY session_id, frame_number""")
def r10_map_location(spark, sf_dir):
    on_map = _mapped(spark, sf_dir).drop("x", "y").withColumnsRenamed({"map_x": "x", "map_y": "y"})
    wide = FR.wide_pose(on_map, ["A", "B"])
    names = {f"{b}_{c}": f"{b}_map_{c}" for b in "AB" for c in "xy"}
    wide = wide.select("session_id", "frame_number", *names).withColumnsRenamed(names)
    return rounded(wide, 5, *names.values())


@query("r11_node_first", _located_sql(f"{_KIND}, ord"))
def r11_node_first(spark, sf_dir):
    return _place(spark, sf_dir, "node_priority")


# The graph of a map: its parts as nodes, and an edge from each to the next one.
_GRAPH = """nodes AS (SELECT p_partkey % n AS map_id, 'P' || p_partkey AS node_id FROM part, (SELECT count(*) AS n FROM supplier)),
links AS (SELECT p_partkey % n AS map_id, 'P' || (p_partkey + n) AS u, 'P' || p_partkey AS v FROM part, (SELECT count(*) AS n FROM supplier)
          WHERE p_partkey + n < (SELECT count(*) FROM part))"""


def _graph(spark, sf_dir):
    n = table(spark, sf_dir, "supplier").select(F.count("*")).scalar()
    most = table(spark, sf_dir, "part").select(F.count("*")).scalar()
    parts = table(spark, sf_dir, "part").select("p_partkey").withColumns({"_n": n, "_most": most})
    k = F.col("p_partkey")
    nodes = parts.select((k % F.col("_n")).alias("map_id"), F.concat(F.lit("P"), k).alias("node_id"))
    edges = parts.where(k + F.col("_n") < F.col("_most")).select(
        (k % F.col("_n")).alias("map_id"),
        F.concat(F.lit("P"), k + F.col("_n")).alias("u"),
        F.concat(F.lit("P"), k).alias("v"),
    )
    return nodes, edges


@query("r12_regions_of_elements", with_ctes("regions", extra=_GRAPH) + """
SELECT n.map_id, n.node_id AS element, r.region_id FROM nodes n JOIN regions r ON r.map_id = n.map_id AND r.node_id = n.node_id
UNION ALL SELECT l.map_id, l.u || '-' || l.v, r.region_id FROM links l JOIN regions r ON r.map_id = l.map_id AND (r.u = l.u AND r.v = l.v OR r.u = l.v AND r.v = l.u)""")
def r12_regions_of_elements(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    shapes = regions(spark, sf_dir)
    by_node = L.regions_of_nodes(nodes, shapes).select("map_id", F.col("node_id").alias("element"), "region_id")
    by_edge = L.regions_of_edges(edges, shapes).select("map_id", F.concat_ws("-", "u", "v").alias("element"), "region_id")
    return by_node.unionByName(by_edge)


@query("r13_unmapped_elements", with_ctes("regions", extra=_GRAPH) + """
SELECT map_id, node_id AS element FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.map_id = n.map_id AND r.node_id = n.node_id)
UNION ALL SELECT map_id, u || '-' || v FROM links l WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.map_id = l.map_id AND r.u = l.v AND r.v = l.u)""")
def r13_unmapped_elements(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    shapes = regions(spark, sf_dir)
    lone = L.unmapped_nodes(nodes, shapes).select("map_id", F.col("node_id").alias("element"))
    bare = L.unmapped_edges(edges, shapes).select("map_id", F.concat_ws("-", "u", "v").alias("element"))
    return lone.unionByName(bare)


@query("k4_mapped_elements", with_ctes("regions", extra=_GRAPH) + """
SELECT n.map_id, 'node' AS element_type, node_id AS element, EXISTS (SELECT 1 FROM regions r WHERE r.map_id = n.map_id AND r.node_id = n.node_id) AS mapped FROM nodes n
UNION ALL SELECT l.map_id, 'edge', least(l.u, l.v) || '-' || greatest(l.u, l.v), EXISTS (SELECT 1 FROM regions r WHERE r.map_id = l.map_id AND r.u = l.v AND r.v = l.u) FROM links l""")
def k4_mapped_elements(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return L.mapped_elements(nodes, edges, regions(spark, sf_dir))


def _inside_sql(alias: str) -> str:
    return f"""(CASE {alias}.kind
   WHEN 'rectangle' THEN x BETWEEN {alias}.cx AND {alias}.cx + {alias}.a AND y BETWEEN {alias}.cy AND {alias}.cy + {alias}.b
   WHEN 'circle' THEN (x - {alias}.cx) ** 2 + (y - {alias}.cy) ** 2 <= {alias}.a ** 2
   WHEN 'ellipse' THEN (((x - {alias}.cx) * cos({alias}.angle) + (y - {alias}.cy) * sin({alias}.angle)) / {alias}.a) ** 2
        + (((y - {alias}.cy) * cos({alias}.angle) - (x - {alias}.cx) * sin({alias}.angle)) / {alias}.b) ** 2 <= 1
   ELSE len(list_filter({alias}.es, lambda e: (e.y1 > y) <> (e.y2 > y) AND x < (e.x2 - e.x1) * (y - e.y1) / (e.y2 - e.y1) + e.x1)) % 2 = 1
     OR len(list_filter({alias}.es, lambda e: (e.x2 - e.x1) * (y - e.y1) = (e.y2 - e.y1) * (x - e.x1)
        AND x BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) AND y BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2))) > 0 END)"""


# x and y run over ten evenly spaced places between the borders of the common box.
_OVERLAP = f"""shaped AS (SELECT r.*, s.es FROM regions r LEFT JOIN (
   SELECT region_id, list({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) AS es FROM sides GROUP BY 1) s ON s.region_id = r.region_id),
boxes AS (SELECT p.map_id, p.region_id AS region1, q.region_id AS region2,
    greatest(p.x0, q.x0) AS lx, least(p.x1, q.x1) AS hx, greatest(p.y0, q.y0) AS ly, least(p.y1, q.y1) AS hy
  FROM regions p JOIN regions q ON q.map_id = p.map_id AND p.ord < q.ord AND p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1),
spots AS (SELECT map_id, region1, region2, CASE i WHEN 9 THEN hx ELSE lx + (hx - lx) / 9 * i END AS x, CASE j WHEN 9 THEN hy ELSE ly + (hy - ly) / 9 * j END AS y
  FROM boxes, range(0, 10) a(i), range(0, 10) b(j)),
meets AS (SELECT DISTINCT s.map_id, region1, region2 FROM spots s JOIN shaped p ON p.region_id = region1 JOIN shaped q ON q.region_id = region2
  WHERE {_inside_sql("p")} AND {_inside_sql("q")})"""


@query("r14_region_overlaps", with_ctes("regions", extra=_OVERLAP) + "SELECT map_id, region1, region2, CAST(1.0 AS DOUBLE) AS severity FROM meets")
def r14_region_overlaps(spark, sf_dir):
    return L.overlapping_regions(regions(spark, sf_dir))


@query("r15_node_conflicts", """
WITH given AS (SELECT DISTINCT p_size AS map_id, p_brand AS region_id, 'P' || p_partkey AS node_id FROM part)
SELECT g.map_id, g.region_id, g.node_id, n.nodes FROM given g
JOIN (SELECT map_id, region_id, count(*) AS nodes FROM given GROUP BY ALL HAVING count(*) > 1) n ON n.map_id = g.map_id AND n.region_id = g.region_id""")
def r15_node_conflicts(spark, sf_dir):
    given = table(spark, sf_dir, "part").select(
        F.col("p_size").alias("map_id"), F.col("p_brand").alias("region_id"), F.concat(F.lit("P"), "p_partkey").alias("node_id")
    )
    return L.node_conflicts(given)


_STATS = """ n AS (SELECT n.map_id, count(*) AS total_nodes, count(r.node_id) AS mapped_nodes
   FROM nodes n LEFT JOIN (SELECT DISTINCT map_id, node_id FROM regions) r ON r.map_id = n.map_id AND r.node_id = n.node_id GROUP BY 1),
e AS (SELECT l.map_id, count(*) AS total_edges, count(r.u) AS mapped_edges
   FROM links l LEFT JOIN (SELECT DISTINCT map_id, u, v FROM regions) r ON r.map_id = l.map_id AND r.u = l.v AND r.v = l.u GROUP BY 1),
g AS (SELECT map_id, count(*) AS total_regions FROM regions GROUP BY 1),
o AS (SELECT map_id, count(DISTINCT region_id) AS over FROM (SELECT map_id, region1 AS region_id FROM meets UNION ALL SELECT map_id, region2 FROM meets) GROUP BY 1)"""


@query("r16_mapping_statistics", with_ctes("regions", extra=f"{_GRAPH},\n{_OVERLAP},\n{_STATS}") + """
SELECT n.map_id, total_nodes, mapped_nodes, total_nodes - mapped_nodes AS unmapped_nodes, total_edges, mapped_edges, total_edges - mapped_edges AS unmapped_edges,
  total_regions, coalesce(over, 0) AS overlapping_regions, round(mapped_nodes / total_nodes * 100, 6) AS node_completeness,
  round(mapped_edges / total_edges * 100, 6) AS edge_completeness, round((mapped_nodes + mapped_edges) / (total_nodes + total_edges) * 100, 6) AS coverage
FROM n JOIN e ON e.map_id = n.map_id JOIN g ON g.map_id = n.map_id LEFT JOIN o ON o.map_id = n.map_id""")
def r16_mapping_statistics(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    stats = L.mapping_statistics(nodes, edges, regions(spark, sf_dir))
    return rounded(stats, 6, "node_completeness", "edge_completeness", "coverage")


# Parts above a size are shifted, each by its own amount.
_OFFSETS = """offsets AS (SELECT p_partkey % n AS map_id, 'region_' || p_partkey AS region_id, CAST(p_size % 7 - 3 AS DOUBLE) + 0.5 AS dx, CAST(p_partkey % 9 AS DOUBLE) - 4.25 AS dy
  FROM part, (SELECT count(*) AS n FROM supplier) WHERE p_size > 25)"""


def offsets(spark, sf_dir):
    n = table(spark, sf_dir, "supplier").select(F.count("*")).scalar()
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").withColumn("_n", n).where("p_size > 25").select(
        (k % F.col("_n")).alias("map_id"),
        F.concat(F.lit("region_"), k).alias("region_id"),
        (F.col("p_size") % 7 - 2.5).cast("double").alias("dx"),
        (k % 9 - 4.25).cast("double").alias("dy"),
    )


@query("r17_session_offsets", with_ctes("regions", extra=_OFFSETS) + """
SELECT r.region_id, round(r.x0 + coalesce(o.dx, 0), 6) AS x0, round(r.y1 + coalesce(o.dy, 0), 6) AS y1, round(r.area, 6) AS area
FROM regions r LEFT JOIN offsets o ON o.map_id = r.map_id AND o.region_id = r.region_id""")
def r17_session_offsets(spark, sf_dir):
    moved = L.shifted(regions(spark, sf_dir), offsets(spark, sf_dir))
    return rounded(moved.select("region_id", "x0", "y1", "area"), 6, "x0", "y1", "area")


@query("r18_offset_collisions", with_ctes("regions", extra=_OFFSETS) + """
SELECT m.map_id, m.region_id AS moved, s.region_id AS hit
FROM (SELECT r.map_id, r.region_id, x0 + dx AS x0, x1 + dx AS x1, y0 + dy AS y0, y1 + dy AS y1
      FROM regions r JOIN offsets o ON o.map_id = r.map_id AND o.region_id = r.region_id) m
JOIN (SELECT * FROM regions r WHERE NOT EXISTS (SELECT 1 FROM offsets o WHERE o.map_id = r.map_id AND o.region_id = r.region_id)) s
ON s.map_id = m.map_id AND m.x0 < s.x1 AND s.x0 < m.x1 AND m.y0 < s.y1 AND s.y0 < m.y1""")
def r18_offset_collisions(spark, sf_dir):
    return L.offset_collisions(regions(spark, sf_dir), offsets(spark, sf_dir))


@query("r20_calibration_quality", with_ctes("pose", extra=f"{_MASKED},\n{_CAL},\n{_MAPPED}") + """
SELECT session_id, round(avg(sqrt((map_x - (x + 2)) ** 2 + (map_y - (y + 1)) ** 2)), 5) AS error, count(*) AS point_pairs
FROM mapped GROUP BY session_id HAVING count(*) >= 4""")
def r20_calibration_quality(spark, sf_dir):
    masked = FR.mask_unlikely(pose(spark, sf_dir), 0.3, {"B": 0.55, "C": -1.0})
    pairs = masked.select(
        "session_id",
        F.col("x").alias("src_x"),
        F.col("y").alias("src_y"),
        (F.col("x") + 2).alias("dst_x"),
        (F.col("y") + 1).alias("dst_y"),
    )
    return rounded(L.reprojection_error(pairs, calibration(spark, sf_dir)), 5, "error")


# Stored and present builders of each map come from its supplier's keys; the present
# graph lacks the largest parts.
@query("r19_builder_mismatches", with_ctes("regions", extra="""built AS (
  SELECT s_suppkey AS map_id, CASE s_nationkey % 2 WHEN 0 THEN 'tree' ELSE 'star' END AS b1, CASE s_suppkey % 3 WHEN 0 THEN 'star' ELSE 'tree' END AS b2,
         s_nationkey % 4 AS h1, s_suppkey % 4 AS h2 FROM supplier),
known AS (SELECT p_partkey % n AS map_id, 'P' || p_partkey AS node_id FROM part, (SELECT count(*) AS n FROM supplier) WHERE p_size < 45)""") + """
SELECT map_id, 'builder' AS reason, b1 || '/' || b2 AS detail FROM built WHERE b1 <> b2
UNION ALL SELECT map_id, 'parameter', 'height' FROM built WHERE b1 = b2 AND h1 <> h2
UNION ALL SELECT DISTINCT r.map_id, 'unknown node', r.node_id FROM regions r
WHERE r.element_type = 'node' AND NOT EXISTS (SELECT 1 FROM known k WHERE k.map_id = r.map_id AND k.node_id = r.node_id)""")
def r19_builder_mismatches(spark, sf_dir):
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")

    def builders(is_tree, height):
        return table(spark, sf_dir, "supplier").select(
            key.alias("map_id"),
            F.when(is_tree, "tree").otherwise("star").alias("builder"),
            F.create_map(F.lit("height"), height.cast("string")).alias("params"),
        )

    n = table(spark, sf_dir, "supplier").select(F.count("*")).scalar()
    small = table(spark, sf_dir, "part").withColumn("_n", n).where("p_size < 45")
    nodes = small.select((F.col("p_partkey") % F.col("_n")).alias("map_id"), F.concat(F.lit("P"), "p_partkey").alias("node_id"))
    return L.builder_mismatches(
        builders(nation % 2 == 0, nation % 4), builders(key % 3 != 0, key % 4), regions(spark, sf_dir), nodes
    )
