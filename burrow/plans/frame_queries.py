"""Masking, projecting, aligning, and series over frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from burrow.functions import angles as A
from burrow.functions.projective import is_usable, project_affine
from burrow.operators import frames as FR
from burrow.operators import metrics as M
from burrow.operators import series as S
from burrow.plans.path_queries import ERROR, PURCHASE, paths_sql
from burrow.plans.registry import query
from burrow.plans.standins import frames, imu, pose, sessions, table, traces, with_ctes
from burrow.sources.tables import stream_info


def rounded(df, digits=6, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


# -- masking and coverage ----------------------------------------------------

_MASKED = """masked AS (
  SELECT session_id, frame_number, bodypart, likelihood,
         CASE WHEN likelihood < t THEN NULL ELSE x END AS x, CASE WHEN likelihood < t THEN NULL ELSE y END AS y
  FROM (SELECT *, CASE bodypart WHEN 'B' THEN 0.55 WHEN 'C' THEN -1.0 ELSE 0.3 END AS t FROM pose))"""


def _masked(spark, sf_dir):
    return FR.mask_unlikely(pose(spark, sf_dir), 0.3, {"B": 0.55, "C": -1.0})


@query("f1_likelihood_mask", with_ctes("pose", extra=_MASKED) + "SELECT * FROM masked")
def f1_likelihood_mask(spark, sf_dir):
    return _masked(spark, sf_dir)


@query("f2_coverage", with_ctes("pose", extra=_MASKED) + """
SELECT session_id, bodypart, round(avg(CASE WHEN x IS NULL THEN 0 ELSE 1 END) * 100, 6) AS coverage,
       avg(CASE WHEN x IS NULL THEN 0 ELSE 1 END) * 100 < 50 AS is_low
FROM masked GROUP BY ALL""")
def f2_coverage(spark, sf_dir):
    return rounded(FR.coverage(_masked(spark, sf_dir), "x", ["session_id", "bodypart"]), 6, "coverage")


# -- projections; every session has a matrix of its own, taken from its supplier ---

_H = "[1.0 + 0.001 * (s_suppkey % 7), 0.02, 3.0, -0.01, 0.9 + 0.001 * (s_suppkey % 5), 2.0, 0.0001, CASE WHEN s_suppkey % 11 = 0 THEN -0.02 ELSE 0.0002 END, 1.0]"
_CAL = f"cal AS (SELECT s_suppkey AS session_id, {_H}::DOUBLE[] AS h FROM supplier)"


def calibration(spark, sf_dir):
    key = F.col("s_suppkey")
    cells = [
        1.0 + 0.001 * (key % 7), F.lit(0.02), F.lit(3.0),
        F.lit(-0.01), 0.9 + 0.001 * (key % 5), F.lit(2.0),
        F.lit(0.0001), F.when(key % 11 == 0, F.lit(-0.02)).otherwise(F.lit(0.0002)), F.lit(1.0),
    ]
    return table(spark, sf_dir, "supplier").select(key.alias("session_id"), F.array(*cells).alias("h"))


_MAPPED = """mapped AS (
  SELECT session_id, frame_number, bodypart, likelihood, x, y,
         CASE WHEN abs(w) > 1e-10 THEN (h[1]*x + h[2]*y + h[3]) / w END AS map_x,
         CASE WHEN abs(w) > 1e-10 THEN (h[4]*x + h[5]*y + h[6]) / w END AS map_y, h
  FROM (SELECT m.*, c.h, h[7]*x + h[8]*y + h[9] AS w FROM masked m LEFT JOIN cal c ON c.session_id = m.session_id))"""


def _mapped(spark, sf_dir):
    return FR.to_map(_masked(spark, sf_dir), calibration(spark, sf_dir))


@query("f3_homography", with_ctes("pose", extra=f"{_MASKED},\n{_CAL},\n{_MAPPED}") + """
SELECT session_id, frame_number, bodypart, round(map_x, 5) AS map_x, round(map_y, 5) AS map_y FROM mapped""")
def f3_homography(spark, sf_dir):
    out = _mapped(spark, sf_dir).select("session_id", "frame_number", "bodypart", "map_x", "map_y")
    return rounded(out, 5, "map_x", "map_y")


_BACK = """back AS (
  SELECT session_id, frame_number, bodypart, map_x, map_y, i, i[7]*map_x + i[8]*map_y + i[9] AS w
  FROM (SELECT *, [
     (h[5]*h[9]-h[6]*h[8])/det, (h[3]*h[8]-h[2]*h[9])/det, (h[2]*h[6]-h[3]*h[5])/det,
     (h[6]*h[7]-h[4]*h[9])/det, (h[1]*h[9]-h[3]*h[7])/det, (h[3]*h[4]-h[1]*h[6])/det,
     (h[4]*h[8]-h[5]*h[7])/det, (h[2]*h[7]-h[1]*h[8])/det, (h[1]*h[5]-h[2]*h[4])/det] AS i
   FROM (SELECT *, h[1]*(h[5]*h[9]-h[6]*h[8]) - h[2]*(h[4]*h[9]-h[6]*h[7]) + h[3]*(h[4]*h[8]-h[5]*h[7]) AS det FROM mapped)))"""


@query("f4_inverse_projection", with_ctes("pose", extra=f"{_MASKED},\n{_CAL},\n{_MAPPED},\n{_BACK}") + """
SELECT session_id, frame_number, bodypart, round(cx, 5) AS camera_x, round(cy, 5) AS camera_y,
       coalesce(cx BETWEEN 0 AND 40.5 AND cy BETWEEN 0 AND 80.5, false) AS in_view
FROM (SELECT *, CASE WHEN abs(w) > 1e-10 THEN (i[1]*map_x + i[2]*map_y + i[3]) / w END AS cx,
             CASE WHEN abs(w) > 1e-10 THEN (i[4]*map_x + i[5]*map_y + i[6]) / w END AS cy FROM back)""")
def f4_inverse_projection(spark, sf_dir):
    out = FR.to_camera(_mapped(spark, sf_dir), calibration(spark, sf_dir), 40.5, 80.5)
    out = out.select("session_id", "frame_number", "bodypart", "camera_x", "camera_y", "in_view")
    return rounded(out, 5, "camera_x", "camera_y")


@query("f5_affine", with_ctes("pose") + """
SELECT session_id, frame_number, bodypart, round(1.5*x - 0.25*y + 4.0, 6) AS ax, round(0.5*x + 2.0*y - 3.0, 6) AS ay
FROM pose""")
def f5_affine(spark, sf_dir):
    m = F.array(*map(F.lit, (1.5, -0.25, 4.0, 0.5, 2.0, -3.0)))
    ax, ay = project_affine(m, F.col("x"), F.col("y"))
    return rounded(
        pose(spark, sf_dir).select("session_id", "frame_number", "bodypart", ax.alias("ax"), ay.alias("ay")), 6, "ax", "ay"
    )


@query("s8_calibration_check", f"WITH {_CAL}" + """,
dets AS (SELECT session_id, session_id % 4 = 0 AS broken,
  h[1]*(h[5]*h[9]-h[6]*h[8]) - h[2]*(h[4]*h[9]-h[6]*h[7]) + h[3]*(h[4]*h[8]-h[5]*h[7]) AS det FROM cal)
SELECT session_id, NOT broken AND abs(det) >= 1e-10 AS usable FROM dets""")
def s8_calibration_check(spark, sf_dir):
    # Every fourth matrix gets a second row equal to its first.
    same = F.transform("h", lambda v, i: F.when(i.between(3, 5), F.col("h")[i - 3]).otherwise(v))
    broken = calibration(spark, sf_dir).withColumn(
        "h", F.when(F.col("session_id") % 4 == 0, same).otherwise(F.col("h"))
    )
    return broken.select("session_id", is_usable(F.col("h")).alias("usable"))


# -- head orientation --------------------------------------------------------

_EULER = """unit AS (SELECT session_id, pos, qw/n AS w, qx/n AS x, qy/n AS y, qz/n AS z
  FROM (SELECT *, sqrt(qw*qw + qx*qx + qy*qy + qz*qz) AS n FROM imu)),
euler AS (SELECT session_id, pos, degrees(atan2(2*(w*z - x*y), 1 - 2*(y*y + z*z))) AS yaw,
  degrees(asin(least(greatest(2*(x*z + w*y), -1.0), 1.0))) AS pitch,
  degrees(atan2(2*(w*x - y*z), 1 - 2*(x*x + y*y))) AS roll FROM unit),
wrapped AS (SELECT *, yaw + 167 + 180 - 360 * floor((yaw + 167 + 180) / 360) - 180 AS shifted FROM euler)"""


def _oriented(spark, sf_dir, **args):
    return FR.head_orientation(imu(spark, sf_dir), **args)


@query("f6_quaternion_angles", with_ctes("imu", extra=_EULER) + """
SELECT session_id, pos, round(yaw, 5) AS yaw, round(pitch, 5) AS pitch, round(roll, 5) AS roll FROM euler""")
def f6_quaternion_angles(spark, sf_dir):
    out = _oriented(spark, sf_dir).select("session_id", "pos", "yaw", "pitch", "roll")
    return rounded(out, 5, "yaw", "pitch", "roll")


@query("f7_calibrated_yaw", with_ctes("imu", extra=_EULER) + "SELECT session_id, pos, round(-shifted, 5) AS yaw FROM wrapped")
def f7_calibrated_yaw(spark, sf_dir):
    out = _oriented(spark, sf_dir, offset=A.YAW_OFFSET, direction=A.YAW_DIRECTION)
    return rounded(out.select("session_id", "pos", "yaw"), 5, "yaw")


@query("f8_wrap_angle", with_ctes("frames") + """
SELECT session_id, frame_number, round(y * 37 + 180 - 360 * floor((y * 37 + 180) / 360) - 180, 6) AS angle FROM frames""")
def f8_wrap_angle(spark, sf_dir):
    out = frames(spark, sf_dir).select("session_id", "frame_number", A.wrap(F.col("y") * 37).alias("angle"))
    return rounded(out, 6, "angle")


@query("f9_degrees_radians", with_ctes("frames") + """
SELECT session_id, frame_number, round(radians(y), 8) AS rad, round(degrees(y), 6) AS deg FROM frames""")
def f9_degrees_radians(spark, sf_dir):
    return frames(spark, sf_dir).select(
        "session_id",
        "frame_number",
        F.round(A.to_radians(F.col("y")), 8).alias("rad"),
        F.round(A.to_degrees(F.col("y")), 6).alias("deg"),
    )


@query("f10_current_element", with_ctes("frames") + """
SELECT session_id, frame_number, coalesce(CASE WHEN node < 3 THEN node END, CASE WHEN node > 6 THEN node END, CASE WHEN state = 'view' THEN node END) AS current,
       (node % 2 = 0) AS forward_or_back FROM frames""")
def f10_current_element(spark, sf_dir):
    node = F.col("node")
    cols = frames(spark, sf_dir).withColumns(
        {
            "graph_node_id": F.when(node < 3, node),
            "a_graph_node": F.when(node > 6, node),
            "b_graph_node": F.when(F.col("state") == "view", node),
        }
    )
    picked = FR.current_element(cols, ["graph_node_id", "a_graph_node", "b_graph_node"])
    even = node % 2
    return picked.select(
        "session_id",
        "frame_number",
        "current",
        FR.same_edge(F.lit(0), node, node, even).alias("forward_or_back"),
    )


@query("f11_on_map", with_ctes("pose") + """
SELECT session_id, frame_number, bodypart, x, y FROM pose WHERE x >= 0 AND x < 30 AND y >= 0 AND y < 70 AND likelihood >= 0.2""")
def f11_on_map(spark, sf_dir):
    return FR.on_map(pose(spark, sf_dir), 30, 70, 0.2).select("session_id", "frame_number", "bodypart", "x", "y")


# -- derived series and alignment --------------------------------------------

_CENTROID = """masked AS (SELECT session_id, frame_number, bodypart, likelihood,
         CASE WHEN likelihood < 0.3 THEN NULL ELSE x END AS x, CASE WHEN likelihood < 0.3 THEN NULL ELSE y END AS y FROM pose)"""


@query("d1_centroid", with_ctes("pose", extra=_CENTROID) + """
SELECT session_id, frame_number, 'mid' AS bodypart, round(avg(x), 6) AS x, round(avg(y), 6) AS y, min(likelihood) AS likelihood
FROM masked WHERE bodypart IN ('A', 'B') GROUP BY session_id, frame_number
UNION ALL SELECT session_id, frame_number, bodypart, x, y, likelihood FROM masked""")
def d1_centroid(spark, sf_dir):
    out = FR.derived_bodypart(FR.mask_unlikely(pose(spark, sf_dir)), "mid", ["A", "B"])
    return rounded(out, 6, "x", "y").select("session_id", "frame_number", "bodypart", "x", "y", "likelihood")


_WIDE = """wide AS (SELECT session_id, frame_number,
  max(CASE WHEN bodypart = 'A' THEN x END) AS A_x, max(CASE WHEN bodypart = 'B' THEN x END) AS B_x FROM pose
  WHERE bodypart IN ('A', 'B') GROUP BY ALL)"""


@query("d2_frame_table", with_ctes("pose", "frames", extra=_WIDE) + """
SELECT w.session_id, w.frame_number, w.A_x, w.B_x, f.state, f.x
FROM wide w LEFT JOIN frames f ON f.session_id = w.session_id AND f.frame_number = w.frame_number""")
def d2_frame_table(spark, sf_dir):
    base = FR.wide_pose(pose(spark, sf_dir), ["A", "B"]).select("session_id", "frame_number", "A_x", "B_x")
    return FR.assemble(
        base, [(frames(spark, sf_dir), ["state", "x"], True), (None, ["yaw"], False)]
    )


@query("d3_sampled_alignment", with_ctes("pose", "imu", extra="axis AS (SELECT DISTINCT session_id, frame_number FROM pose)") + """
SELECT a.session_id, a.frame_number, round(i.qw, 6) AS qw FROM axis a
LEFT JOIN imu i ON i.session_id = a.session_id AND i.pos = a.frame_number * 3""")
def d3_sampled_alignment(spark, sf_dir):
    axis = pose(spark, sf_dir).select("session_id", "frame_number").distinct()
    samples = imu(spark, sf_dir).withColumn("session_id", F.col("session_id").cast("bigint"))
    return rounded(FR.align_sampled(axis, samples, 3, ["qw"]), 6, "qw")


_LONG_AXIS = "axis AS (SELECT CAST(0 AS BIGINT) AS session_id, c_custkey - 1 AS frame_number FROM customer)"


def _long_axis(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.lit(0).cast("bigint").alias("session_id"), (F.col("c_custkey") - 1).alias("frame_number")
    )


@query("d4_truncate_pad", with_ctes("traces", extra=_LONG_AXIS) + """
SELECT a.frame_number, round(t.c, 6) AS c FROM axis a
LEFT JOIN (SELECT frame_number, max(c) AS c FROM traces GROUP BY 1) t ON t.frame_number = a.frame_number""")
def d4_truncate_pad(spark, sf_dir):
    peak = traces(spark, sf_dir).groupBy("session_id", "frame_number").agg(F.max("c").alias("c"))
    out = FR.align_by_position(_long_axis(spark, sf_dir), peak, ["c"])
    return rounded(out.select("frame_number", "c"), 6, "c")


@query("d5_frame_clamp", with_ctes("pose", "sessions") + """
SELECT p.session_id, p.frame_number, p.bodypart, least(greatest(p.frame_number, 0), s.frame_count - 1) AS other_frame
FROM pose p JOIN sessions s ON s.session_id = p.session_id""")
def d5_frame_clamp(spark, sf_dir):
    counts = sessions(spark, sf_dir).select("session_id", "frame_count")
    other = FR.clamped_frame(F.col("frame_number"), F.col("frame_count"))
    return pose(spark, sf_dir).join(counts, "session_id").select(
        "session_id", "frame_number", "bodypart", other.alias("other_frame")
    )


@query("d6_mean_over_units", with_ctes("traces") + """
SELECT session_id, frame_number, round(avg(CASE WHEN abs(c) > 0.02 THEN c END), 6) AS mean_c FROM traces GROUP BY ALL""")
def d6_mean_over_units(spark, sf_dir):
    seen = traces(spark, sf_dir).withColumn("c", F.expr("CASE WHEN abs(c) > 0.02 THEN c END"))
    return rounded(FR.mean_over_units(seen), 6, "mean_c")


@query("d7_modulated_footprints", with_ctes("traces", extra=_LONG_AXIS + """,
units AS (SELECT DISTINCT unit_id, 3 + unit_id % 4 AS points FROM traces)""") + """
SELECT a.frame_number, u.unit_id, CAST(u.points AS INTEGER) AS points, round(coalesce(t.c, 0.0), 6) AS activity
FROM axis a JOIN units u ON true
LEFT JOIN traces t ON t.frame_number = a.frame_number AND t.unit_id = u.unit_id""")
def d7_modulated_footprints(spark, sf_dir):
    out = FR.modulated_footprints(_long_axis(spark, sf_dir), traces(spark, sf_dir), _contours(spark, sf_dir))
    return out.select(
        "frame_number", "unit_id", F.size("contour").alias("points"), F.round("activity", 6).alias("activity")
    )


def _contours(spark, sf_dir):
    """A contour of 3 to 6 points for every unit that was traced."""
    unit = F.col("unit_id")
    ring = F.transform(
        F.sequence(F.lit(0).cast("bigint"), 2 + unit % 4),
        lambda i: F.struct((unit + F.cos(i)).alias("x"), (unit + F.sin(i)).alias("y")),
    )
    units = traces(spark, sf_dir).select("session_id", "unit_id").distinct()
    return units.withColumn("contour", ring)


_PIXELS = """pix AS (SELECT vec_id AS unit_id, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x,
    CAST(embedding[i] AS DOUBLE) AS w FROM embeddings, range(1, 65) AS r(i)),
lev AS (SELECT p.*, CAST(floor((w - mn) / (mx - mn) * 255) AS INTEGER) AS level
  FROM pix p JOIN (SELECT unit_id, min(w) AS mn, max(w) AS mx FROM pix GROUP BY 1) s ON s.unit_id = p.unit_id WHERE mx > mn),
cut AS (SELECT unit_id, quantile_cont(level, 0.5) AS c FROM lev WHERE level > 0 GROUP BY 1),
mask AS (SELECT l.* FROM lev l JOIN cut ON cut.unit_id = l.unit_id WHERE level > c)"""


def footprints(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        F.lit(0).cast("bigint").alias("session_id"), F.col("vec_id").alias("unit_id"), F.posexplode("embedding").alias("_i", "_w")
    )
    return rows.select(
        "session_id",
        "unit_id",
        F.floor(F.col("_i") / 8).cast("int").alias("y"),
        (F.col("_i") % 8).cast("int").alias("x"),
        F.col("_w").cast("double").alias("w"),
    )


@query("d8_footprint_mask", f"WITH {_PIXELS} SELECT unit_id, x, y, level FROM mask")
def d8_footprint_mask(spark, sf_dir):
    return FR.footprint_mask(footprints(spark, sf_dir)).select("unit_id", "x", "y", "level")


@query("d8_footprint_shape", f"""WITH {_PIXELS} SELECT unit_id, count(*) AS pixels, min(x) AS min_x, max(x) AS max_x,
  min(y) AS min_y, max(y) AS max_y, round(avg(x), 6) AS center_x, round(avg(y), 6) AS center_y FROM mask GROUP BY unit_id""")
def d8_footprint_shape(spark, sf_dir):
    shape = FR.footprint_shape(FR.footprint_mask(footprints(spark, sf_dir)))
    return rounded(shape.drop("session_id"), 6, "center_x", "center_y")


@query("d9_frame_speed", with_ctes("frames") + """
SELECT session_id, frame_number, round(speed, 5) AS speed,
       round(CASE WHEN count(speed) OVER w = 10 THEN avg(speed) OVER w END, 5) AS smooth_speed
FROM (SELECT *, sqrt((x - lag(x) OVER f) ** 2 + (y - lag(y) OVER f) ** 2) AS speed FROM frames
      WINDOW f AS (PARTITION BY session_id ORDER BY frame_number))
WINDOW w AS (PARTITION BY session_id ORDER BY frame_number ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)""")
def d9_frame_speed(spark, sf_dir):
    out = FR.frame_speed(frames(spark, sf_dir))
    return rounded(out.select("session_id", "frame_number", "speed", "smooth_speed"), 5, "speed", "smooth_speed")


# -- series ------------------------------------------------------------------

_UNWRAP = """ang AS (SELECT session_id, pos, CASE WHEN pos % 9 = 4 THEN 175.0 WHEN pos % 9 = 5 THEN -170.0 ELSE qw * 1000 END AS a FROM imu),
dd AS (SELECT *, a - lag(a) OVER (PARTITION BY session_id ORDER BY pos) AS d FROM ang),
mm AS (SELECT *, d + 180 - 360 * floor((d + 180) / 360) - 180 AS m FROM dd),
un AS (SELECT session_id, pos, a + sum(CASE WHEN abs(d) >= 180 THEN (CASE WHEN m = -180 AND d > 0 THEN 180 ELSE m END) - d ELSE 0 END)
   OVER (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS u FROM mm),
vel AS (SELECT session_id, pos, u, coalesce((lead(u) OVER w - lag(u) OVER w) / 2, lead(u) OVER w - u, u - lag(u) OVER w) / 0.5 AS v
   FROM un WINDOW w AS (PARTITION BY session_id ORDER BY pos))"""


def _angles(spark, sf_dir):
    pos = F.col("pos")
    angle = F.when(pos % 9 == 4, 175.0).when(pos % 9 == 5, -170.0).otherwise(F.col("qw") * 1000)
    return imu(spark, sf_dir).select("session_id", "pos", angle.alias("a"))


@query("w1_unwrap", with_ctes("imu", extra=_UNWRAP) + "SELECT session_id, pos, round(u, 5) AS unwrapped FROM un")
def w1_unwrap(spark, sf_dir):
    out = S.unwrap(_angles(spark, sf_dir), "a", "pos")
    return rounded(out.select("session_id", "pos", "unwrapped"), 5, "unwrapped")


@query("w2_angular_velocity", with_ctes("imu", extra=_UNWRAP) + "SELECT session_id, pos, round(v, 4) AS velocity FROM vel")
def w2_angular_velocity(spark, sf_dir):
    out = S.angular_velocity(_angles(spark, sf_dir), "a", "pos", dt=0.5)
    return rounded(out.select("session_id", "pos", "velocity"), 4, "velocity")


@query("w2_velocity_uneven", with_ctes("imu", extra=_UNWRAP) + """
SELECT session_id, pos, round(CASE WHEN hs IS NULL THEN (n - u) / hd WHEN hd IS NULL THEN (u - l) / hs
  ELSE (hs*hs*n + (hd*hd - hs*hs)*u - hd*hd*l) / (hs*hd*(hs + hd)) END, 4) AS velocity
FROM (SELECT session_id, pos, u, lag(u) OVER w AS l, lead(u) OVER w AS n, t - lag(t) OVER w AS hs, lead(t) OVER w - t AS hd
      FROM (SELECT *, CAST(pos + 0.25 * (pos % 3) AS DOUBLE) AS t FROM un) WINDOW w AS (PARTITION BY session_id ORDER BY pos))""")
def w2_velocity_uneven(spark, sf_dir):
    rows = _angles(spark, sf_dir).withColumn("t", F.col("pos") + 0.25 * (F.col("pos") % 3))
    out = S.angular_velocity(rows, "a", "pos", position="t")
    return rounded(out.select("session_id", "pos", "velocity"), 4, "velocity")


@query("w3_smoothing", with_ctes("imu", extra=_UNWRAP) + """
SELECT session_id, pos, round(sum(v) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4, 4) AS velocity FROM vel""")
def w3_smoothing(spark, sf_dir):
    out = S.angular_velocity(_angles(spark, sf_dir), "a", "pos", dt=0.5, smooth_window=4)
    return rounded(out.select("session_id", "pos", "velocity"), 4, "velocity")


@query("w4_trail", with_ctes("pose") + """
SELECT session_id, bodypart, frame_number, CAST(len(xs) AS INTEGER) AS points, xs[1] AS oldest_x,
       round(list_sum(list_transform(xs, lambda v, i: v * i / len(xs))), 5) AS weighted_x
FROM (SELECT session_id, bodypart, frame_number,
        list(x) OVER (PARTITION BY session_id, bodypart ORDER BY frame_number ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS xs
      FROM pose WHERE x >= 0 AND x < 30 AND y >= 0 AND y < 70 AND likelihood >= 0.2)""")
def w4_trail(spark, sf_dir):
    out = S.trail(FR.on_map(pose(spark, sf_dir), 30, 70, 0.2))
    weighted = F.aggregate("trail", F.lit(0.0), lambda acc, p: acc + p["x"] * p["weight"])
    return out.select(
        "session_id",
        "bodypart",
        "frame_number",
        F.size("trail").alias("points"),
        F.col("trail")[0]["x"].alias("oldest_x"),
        F.round(weighted, 5).alias("weighted_x"),
    )


@query("w5_trace_window", with_ctes("traces") + """
SELECT unit_id, frame_number, round(c, 6) AS current, round(lo - CASE WHEN lo <> hi THEN (hi - lo) * 0.1 ELSE 1.0 END, 6) AS y_low,
  round(hi + CASE WHEN lo <> hi THEN (hi - lo) * 0.1 ELSE 1.0 END, 6) AS y_high, greatest(frame_number + 1 - 150, 0) AS x_offset
FROM (SELECT *, min(c) OVER w AS lo, max(c) OVER w AS hi FROM traces
      WINDOW w AS (PARTITION BY unit_id ORDER BY frame_number ROWS BETWEEN 149 PRECEDING AND CURRENT ROW))""")
def w5_trace_window(spark, sf_dir):
    out = S.trace_window(
        traces(spark, sf_dir), "c", "frame_number", continuous=True, keys=["session_id", "unit_id"]
    )
    return rounded(
        out.select("unit_id", "frame_number", "current", "y_low", "y_high", "x_offset"), 6, "current", "y_low", "y_high"
    )


_ACTIVE = """active AS (SELECT frame_number, unit_id, c AS activity FROM traces WHERE c > 0.05 AND c < 0.25),
top AS (SELECT *, CAST(rk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY frame_number ORDER BY activity DESC, unit_id) AS rk FROM active) WHERE rk <= 12)"""


def _active(spark, sf_dir):
    # Saturated units stand for those without a contour.
    contour = F.when(F.col("c") >= 0.25, F.array().cast("array<double>")).otherwise(F.array(F.lit(1.0)))
    rows = traces(spark, sf_dir).withColumn("contour", contour).withColumnRenamed("c", "activity")
    return S.active_units(rows).select("session_id", "frame_number", "unit_id", "activity")


@query("k1_active_units", with_ctes("traces", extra=_ACTIVE) + "SELECT frame_number, unit_id, round(activity, 6) AS activity FROM active")
def k1_active_units(spark, sf_dir):
    return rounded(_active(spark, sf_dir).drop("session_id"), 6, "activity")


@query("k2_top_units", with_ctes("traces", extra=_ACTIVE) + "SELECT frame_number, unit_id, rank FROM top")
def k2_top_units(spark, sf_dir):
    return S.top_units(_active(spark, sf_dir), 12).select("frame_number", "unit_id", "rank")


@query("k3_normalised_activity", with_ctes("traces", extra=_ACTIVE) + """
SELECT frame_number, unit_id, round(CASE WHEN hi > lo THEN (activity - lo) / (hi - lo) ELSE 1.0 END, 6) AS normalised
FROM (SELECT *, min(activity) OVER (PARTITION BY frame_number) AS lo, max(activity) OVER (PARTITION BY frame_number) AS hi FROM top)""")
def k3_normalised_activity(spark, sf_dir):
    out = S.normalised_activity(S.top_units(_active(spark, sf_dir), 12))
    return rounded(out.select("frame_number", "unit_id", "normalised"), 6, "normalised")


# -- sessions ----------------------------------------------------------------

@query("s7_stream_info", with_ctes("sessions") + """
SELECT session_id, coalesce(fps, 0.0) AS fps, frame_count,
       round(CASE WHEN coalesce(fps, 0.0) > 0 THEN frame_count / fps ELSE 0.0 END, 6) AS duration FROM sessions""")
def s7_stream_info(spark, sf_dir):
    rows = sessions(spark, sf_dir).withColumn("fps", F.coalesce("fps", F.lit(0.0)))
    return rounded(stream_info(rows).select("session_id", "fps", "frame_count", "duration"), 6, "duration")


@query("m1_exploration", with_ctes("frames") + """
SELECT session_id, round(count(DISTINCT node) / 10 * 100, 6) AS exploration FROM frames GROUP BY session_id""")
def m1_exploration(spark, sf_dir):
    return rounded(M.exploration(frames(spark, sf_dir), "node", graph_totals=(10, 15)), 6, "exploration")


@query("m2_frame_count", with_ctes("frames", "sessions") + """
SELECT s.session_id, count(f.frame_number) AS num_frames FROM sessions s LEFT JOIN frames f ON f.session_id = s.session_id GROUP BY ALL""")
def m2_frame_count(spark, sf_dir):
    return M.frame_count(frames(spark, sf_dir), sessions(spark, sf_dir))


SPEC = {"start_column": "state", "start_value": "error", "end_column": "state", "end_value": "purchase"}


def _battery(spark, sf_dir):
    context = M.Context(frames(spark, sf_dir), sessions(spark, sf_dir), graph_totals=(10, 15))
    return M.battery(
        context,
        {
            "time": ("time_a_to_b", SPEC),
            "nodes": ("num_values_in_path", SPEC | {"count_column": "node", "mode": "unique"}),
            "explored": ("exploration_percentage", {"location_column": "node"}),
            "broken": ("num_values_in_path", SPEC | {"start_column": "no_such_column", "count_column": "node"}),
        },
    )


_BATTERY = """battery AS (
  SELECT p.session_id, 'time' AS metric, p.path_id, (p.end_frame - p.start_frame) / coalesce(s.fps, 30.0) AS value
  FROM paths p LEFT JOIN sessions s ON s.session_id = p.session_id
  UNION ALL
  SELECT p.session_id, 'nodes', p.path_id, CAST(count(DISTINCT f.node) AS DOUBLE)
  FROM paths p JOIN frames f ON f.session_id = p.session_id AND f.frame_number BETWEEN p.start_frame AND p.end_frame
  GROUP BY p.session_id, p.path_id
  UNION ALL SELECT session_id, 'explored', NULL, count(DISTINCT node) / 10 * 100 FROM frames GROUP BY session_id
  UNION ALL SELECT DISTINCT session_id, 'broken', CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) FROM frames)"""


@query("m3_metric_battery", paths_sql(
    ERROR, PURCHASE, "SELECT session_id, metric, path_id, round(value, 6) AS value FROM battery",
    ctes=("frames", "sessions"), extra=_BATTERY))
def m3_metric_battery(spark, sf_dir):
    return rounded(_battery(spark, sf_dir), 6, "value")


@query("m4_learning_progression", paths_sql(
    ERROR, PURCHASE, """
SELECT pos, b.session_id, path_id, round(value, 6) AS value FROM battery b
JOIN (SELECT session_id, row_number() OVER (ORDER BY session_id) - 1 AS pos
      FROM (SELECT DISTINCT session_id FROM battery WHERE metric = 'time')) o ON o.session_id = b.session_id
WHERE metric = 'time'""", ctes=("frames", "sessions"), extra=_BATTERY))
def m4_learning_progression(spark, sf_dir):
    return rounded(M.learning_progression(_battery(spark, sf_dir), "time"), 6, "value")


@query("m5_session_gate", with_ctes("frames") + """
SELECT session_id, count(*) AS num_frames FROM frames
WHERE (SELECT count(DISTINCT session_id) FROM frames) >= 2 GROUP BY session_id""")
def m5_session_gate(spark, sf_dir):
    rows = frames(spark, sf_dir)
    return M.if_many_sessions(M.frame_count(rows), rows)
