"""Queries once more, with parameters so small that the forms for large data act.

Rows and SQL are those of the plain queries; only chunk sizes, salting targets
and broadcast bounds differ. The queries over gaps leave out every third frame.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from burrow.operators import frames as FR
from burrow.operators import graph as GR
from burrow.operators import locate as L
from burrow.operators import paths as P
from burrow.operators import series as S
from burrow.operators.efficiency import route_scores
from burrow.plans.frame_queries import _angles, rounded
from burrow.plans.network_queries import _from_s0, _route, g0, sales
from burrow.plans.path_queries import _error_to_purchase, _gappy, _holes
from burrow.plans.place_queries import _place, _points
from burrow.plans.registry import ORACLES, query
from burrow.plans.standins import frames, regions, table

CHUNK = 16
TARGET = 50
GAPS = "FROM (SELECT * FROM frames WHERE frame_number % 3 <> 2) frames"


def again(name: str):
    """The same query under another name, with the same SQL."""
    return query(f"{name}_small_chunks", ORACLES[name])


@again("t2_transitions")
def t2(spark, sf_dir):
    return _error_to_purchase(spark, sf_dir, chunk_frames=CHUNK)


@again("t3_last_end")
def t3(spark, sf_dir):
    return _error_to_purchase(spark, sf_dir, first_end=False, chunk_frames=CHUNK)


@again("p1_distinct_in_path")
def p1(spark, sf_dir):
    return P.distinct_in_path(_gappy(spark, sf_dir), _error_to_purchase(spark, sf_dir), "node", chunk_frames=CHUNK)


@again("p2_changes_in_path")
def p2(spark, sf_dir):
    return P.changes_in_path(_gappy(spark, sf_dir), _error_to_purchase(spark, sf_dir), "node", chunk_frames=CHUNK)


@again("p3_path_sequence")
def p3(spark, sf_dir):
    return P.sequence_in_path(_gappy(spark, sf_dir), _error_to_purchase(spark, sf_dir), "node", chunk_frames=CHUNK)


@again("p4_path_distance")
def p4(spark, sf_dir):
    moved = P.distance_in_path(_holes(spark, sf_dir), _error_to_purchase(spark, sf_dir), chunk_frames=CHUNK)
    return moved.withColumn("distance", F.round("distance", 5))


@again("p8_shortest_path_efficiency")
def p8(spark, sf_dir):
    scores = route_scores(
        _gappy(spark, sf_dir), _error_to_purchase(spark, sf_dir), "node", _route(spark, sf_dir), piece=8, chunk_frames=CHUNK
    )
    return rounded(scores, 6, "efficiency")


@again("d9_frame_speed")
def d9(spark, sf_dir):
    out = FR.frame_speed(frames(spark, sf_dir), chunk_frames=CHUNK)
    return rounded(out.select("session_id", "frame_number", "speed", "smooth_speed"), 5, "speed", "smooth_speed")


@query("d9_frame_speed_gaps", ORACLES["d9_frame_speed"].replace("FROM frames", GAPS))
def d9_gaps(spark, sf_dir):
    out = FR.frame_speed(frames(spark, sf_dir).where("frame_number % 3 <> 2"), chunk_frames=CHUNK)
    return rounded(out.select("session_id", "frame_number", "speed", "smooth_speed"), 5, "speed", "smooth_speed")


@again("w1_unwrap")
def w1(spark, sf_dir):
    out = S.unwrap(_angles(spark, sf_dir), "a", "pos", chunk_frames=CHUNK)
    return rounded(out.select("session_id", "pos", "unwrapped"), 5, "unwrapped")


@again("w2_angular_velocity")
def w2(spark, sf_dir):
    out = S.angular_velocity(_angles(spark, sf_dir), "a", "pos", dt=0.5, chunk_frames=CHUNK)
    return rounded(out.select("session_id", "pos", "velocity"), 4, "velocity")


@again("w3_smoothing")
def w3(spark, sf_dir):
    out = S.angular_velocity(_angles(spark, sf_dir), "a", "pos", dt=0.5, smooth_window=4, chunk_frames=CHUNK)
    return rounded(out.select("session_id", "pos", "velocity"), 4, "velocity")


@query("r7_matching_regions_shuffled", ORACLES["r1_r2_r7_matching_regions"])
def r7(spark, sf_dir):
    found = L.matching_regions(_points(spark, sf_dir), regions(spark, sf_dir), target=TARGET, broadcast_bytes=0)
    return found.select("session_id", "frame_number", "bodypart", "region_id")


@query("r8_smallest_region_shuffled", ORACLES["r8_smallest_region"])
def r8(spark, sf_dir):
    return _place(spark, sf_dir, "smallest_region", target=TARGET, broadcast_bytes=0)


@query("g4_path_length_salted", ORACLES["g4_path_length"])
def g4(spark, sf_dir):
    reached = GR.shortest_paths(sales(spark, sf_dir), _from_s0(spark), target=TARGET)
    pairs = table(spark, sf_dir, "part").select(
        g0().alias("graph_id"), F.lit("S0").alias("source"), F.concat(F.lit("P"), "p_partkey").alias("target")
    )
    return GR.path_lengths(pairs, reached).select("target", "length")


