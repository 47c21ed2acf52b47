"""Readers and writers applied to the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from burrow.operators import frames as FR
from burrow.operators import metrics as M
from burrow.operators.chunks import with_ordinal
from burrow.plans.frame_queries import _BATTERY, _battery
from burrow.plans.path_queries import ERROR, PURCHASE, paths_sql
from burrow.plans.registry import query
from burrow.plans.standins import frames, imu, pose, regions, table, traces, with_ctes
from burrow.sources import mapping as SM
from burrow.sources import sinks, tables


@query("s1_natural_session_order", "SELECT 'session_' || c_custkey AS session_id, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer")
def s1_natural_session_order(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("session_"), "c_custkey").alias("session_id"))
    order = [F.to_json(F.array(M.natural_key("session_id"))), F.col("session_id")]
    return with_ordinal(names, [], order, "pos")


@query("s4_long_pose", with_ctes("pose") + """
SELECT f.session_id, f.frame_number, b.bodypart, p.x, p.y, p.likelihood
FROM (SELECT DISTINCT session_id, frame_number FROM pose) f, (VALUES ('A'), ('C')) b(bodypart)
LEFT JOIN pose p ON p.session_id = f.session_id AND p.frame_number = f.frame_number AND p.bodypart = b.bodypart""")
def s4_long_pose(spark, sf_dir):
    return tables.long_pose(FR.wide_pose(pose(spark, sf_dir), ["A", "B", "C"]), ["A", "C", "no such part"])


@query("s5_orientation_samples", with_ctes("imu") + """
SELECT session_id, sample_no, row_number() OVER (PARTITION BY session_id ORDER BY sample_no) - 1 AS pos, round(qw, 6) AS qw
FROM imu WHERE abs(qw) >= 0.05""")
def s5_orientation_samples(spark, sf_dir):
    # Small values read as missing, to leave gaps that are dropped before numbering.
    gappy = imu(spark, sf_dir).drop("pos").withColumn("qw", F.when(F.abs("qw") >= 0.05, F.col("qw")))
    out = tables.orientation_samples(gappy)
    return out.select("session_id", "sample_no", "pos", F.round("qw", 6).alias("qw"))


@query("s6_select_traces", with_ctes("traces") + "SELECT session_id, unit_id, frame_number, round(c, 6) AS c FROM traces")
def s6_select_traces(spark, sf_dir):
    both = traces(spark, sf_dir).withColumn("s", F.col("c") * 2)
    out = tables.select_traces(both, ["C"])
    return out.withColumn("c", F.round("c", 6))


@query("s11_s15_map_documents", with_ctes("regions") + """
SELECT map_id, CASE element_type WHEN 'node' THEN 'node_' || node_id ELSE 'edge_' || u || '_' || v END || '_region_0' AS region_id, element_type,
  CAST(CASE kind WHEN 'polygon' THEN 5 ELSE 4 END AS INTEGER) AS corners,
  round(CASE kind WHEN 'polygon' THEN cx - a ELSE cx END, 6) AS first_x, round(CASE kind WHEN 'polygon' THEN cy - b ELSE cy END, 6) AS first_y
FROM regions WHERE kind IN ('polygon', 'rectangle')""")
def s11_s15_map_documents(spark, sf_dir):
    found = SM.regions_of_documents(SM.documents(regions(spark, sf_dir)).withColumn("map_id", F.col("map_id").cast("string")))
    return found.select(
        F.col("map_id").cast("bigint").alias("map_id"),
        "region_id",
        "element_type",
        F.size("points").alias("corners"),
        F.round(F.col("points")[0]["x"], 6).alias("first_x"),
        F.round(F.col("points")[0]["y"], 6).alias("first_y"),
    )


@query("s12_session_table", paths_sql(ERROR, PURCHASE, """
SELECT f.session_id, f.n AS num_frames, l.nodes, CAST(e.value AS VARCHAR) AS explored
FROM (SELECT session_id, count(*) AS n FROM frames GROUP BY 1) f
LEFT JOIN (SELECT session_id, CAST(to_json(list(value ORDER BY path_id)) AS VARCHAR) AS nodes FROM battery WHERE metric = 'nodes' GROUP BY 1) l ON l.session_id = f.session_id
LEFT JOIN battery e ON e.session_id = f.session_id AND e.metric = 'explored'""", ctes=("frames", "sessions"), extra=_BATTERY))
def s12_session_table(spark, sf_dir):
    counts = M.frame_count(frames(spark, sf_dir))
    return sinks.session_table(_battery(spark, sf_dir), counts, ["nodes", "explored"])


@query("s14_map_summary", with_ctes("regions") + """
SELECT map_id, region_id, element_type, CASE element_type WHEN 'edge' THEN u || '-' || v ELSE node_id END AS element_id, kind AS region_type,
  round(center_x, 6) AS center_x, round(center_y, 6) AS center_y, round(area, 6) AS area FROM regions""")
def s14_map_summary(spark, sf_dir):
    out = SM.summary(regions(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("center_x", "center_y", "area")})
