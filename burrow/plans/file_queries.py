"""Readers and sinks as round trips: the given tables are written to the work
folder in a format, read back by the operator, and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from burrow.plans.frame_queries import rounded
from burrow.plans.network_queries import _TRADE, trade
from burrow.plans.registry import ORACLES, query
from burrow.plans.standins import frames, table, with_ctes
from burrow.session import work_folder
from burrow.sources import catalogue, graphs, sinks

_LINKS = "SELECT u, v, round(weight, 6) AS weight FROM links"


def _folder(spark, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _written(spark, lines, kind: str):
    """One file, as a graph is one, read back by the reader of ``kind``."""
    folder = _folder(spark, kind)
    lines.coalesce(1).sortWithinPartitions("at").select("line").write.text(folder)
    return graphs.read_graphs(spark, folder, kind)


def _xml(spark, sf_dir, edge: str, head: str, tail: str):
    rows = trade(spark, sf_dir)
    nodes = rows.select(F.explode(F.array("u", "v")).alias("n")).distinct()
    lines = nodes.select(F.lit(1).alias("at"), F.format_string('<node id="%s"></node>', "n").alias("line"))
    edges = rows.select(F.lit(2).alias("at"), F.format_string(edge, "u", "v", F.col("weight").cast("string")).alias("line"))
    frame = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("at"), F.lit(t).alias("line")) for n, t in ((0, head), (3, tail))])).alias("x"))
    return lines.unionByName(edges).unionByName(frame.select("x.*"))


@query("s9_graphml_round_trip", f"WITH {_TRADE} {_LINKS}")
def s9_graphml_round_trip(spark, sf_dir):
    lines = _xml(
        spark,
        sf_dir,
        '<edge source="%s" target="%s"><data key="d0">%s</data></edge>',
        '<graphml><key id="d0" for="edge" attr.name="weight"></key><graph>',
        "</graph></graphml>",
    )
    return rounded(_written(spark, lines, "graphml")[1].select("u", "v", "weight"), 6, "weight")


@query("s9_gexf_round_trip", f"WITH {_TRADE} {_LINKS}")
def s9_gexf_round_trip(spark, sf_dir):
    edges = _written(spark, _xml(spark, sf_dir, '<edge source="%s" target="%s" weight="%s"></edge>', "<gexf><graph>", "</graph></gexf>"), "gexf")[1]
    return rounded(edges.select("u", "v", "weight"), 6, "weight")


@query("s10_gml_round_trip", f"WITH {_TRADE} {_LINKS}")
def s10_gml_round_trip(spark, sf_dir):
    rows = trade(spark, sf_dir)
    nodes = rows.select(F.explode(F.array("u", "v")).alias("n")).distinct()
    named = nodes.select(F.lit(1).alias("at"), F.format_string('node [ id %s label "%s" ]', F.xxhash64("n").cast("string"), "n").alias("line"))
    ends = [F.xxhash64(c).cast("string") for c in ("u", "v")]
    lines = named.unionByName(
        rows.select(F.lit(2).alias("at"), F.format_string("edge [ source %s target %s weight %s ]", *ends, F.col("weight").cast("string")).alias("line"))
    )
    return rounded(_written(spark, lines, "gml")[1].select("u", "v", "weight"), 6, "weight")


@query("s10_edgelist_round_trip", f"WITH {_TRADE} {_LINKS}")
def s10_edgelist_round_trip(spark, sf_dir):
    weight = F.col("weight").cast("string")
    lines = trade(spark, sf_dir).select(F.lit(0).alias("at"), F.format_string("%s %s {'weight': %s}", "u", "v", weight).alias("line"))
    return rounded(_written(spark, lines, "edgelist")[1].select("u", "v", "weight"), 6, "weight")


@query("s10_adjlist_round_trip", f"WITH {_TRADE} SELECT u, v FROM links")
def s10_adjlist_round_trip(spark, sf_dir):
    rows = trade(spark, sf_dir).groupBy("u").agg(F.array_join(F.sort_array(F.collect_list("v")), " ").alias("vs"))
    lines = rows.select(F.lit(0).alias("at"), F.concat_ws(" ", "u", "vs").alias("line"))
    return _written(spark, lines, "adjlist")[1].select("u", "v")


@query("s13_frames_round_trip", with_ctes("frames") + "SELECT session_id, frame_number, state, round(x, 6) AS x FROM frames")
def s13_frames_round_trip(spark, sf_dir):
    folder = _folder(spark, "frames")
    sinks.write_frames(frames(spark, sf_dir), folder, chunk_frames=16)
    return rounded(spark.read.parquet(folder).select(F.col("session_id").cast("bigint"), "frame_number", "state", "x"), 6, "x")


@query("s16_walks_round_trip", ORACLES["g4_shortest_path_nodes"])
def s16_walks_round_trip(spark, sf_dir):
    from burrow.plans.network_queries import g4_shortest_path_nodes

    folder = _folder(spark, "walks")
    walks = g4_shortest_path_nodes(spark, sf_dir).select("target", F.split("path", ">").alias("path"))
    sinks.write_walks(walks, walks.groupBy(F.size("path").alias("length")).count(), {"start": "R0"}, folder)
    back = spark.read.schema(walks.schema).json(f"{folder}/paths")
    return back.select("target", F.array_join("path", ">").alias("path"))


# A session is the orders of 25 customers; each status is a source with files of its
# own format, which some sessions lack.
_FORMATS = {"F": ("frames", "parquet", 4), "O": ("notes", "json", 3), "P": ("plan", "csv", 5)}
_SOURCES = [{"source": source, "pattern": rf"\.{ending.upper()}$"} for source, ending, _ in _FORMATS.values()]
_THERE = "kinds AS (SELECT DISTINCT o_custkey // 25 AS slot, o_orderstatus AS status FROM orders),\nthere AS (" + " UNION ALL ".join(
    f"SELECT slot, '{source}' AS source FROM kinds WHERE status = '{status}' AND slot % {lacks} <> 0"
    for status, (source, _, lacks) in _FORMATS.items()
) + f"""),
asked AS (SELECT slot, s.source FROM (SELECT DISTINCT slot FROM there), (VALUES {', '.join(f"('{x[0]}')" for x in _FORMATS.values())}) s(source))"""


def _matched(spark, sf_dir):
    folder = _folder(spark, "sessions")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_custkey") / 25).alias("_slot"), F.col("o_orderstatus").alias("_status"), "o_orderkey", "o_totalprice"
    )
    for status, (_, ending, lacks) in _FORMATS.items():
        rows = orders.where((F.col("_status") == status) & (F.col("_slot") % lacks != 0))
        rows = rows.select(F.concat(F.lit("session_"), "_slot").alias("session"), "o_orderkey", "o_totalprice")
        # A task makes and commits its own files: a number of tasks that follows from the few
        # bytes of a session would leave thousands of files to each, and the driver would move them singly.
        files = rows.repartition(parts, "session").write.mode("append").partitionBy("session").format(ending)
        files.option("mapreduce.fileoutputcommitter.algorithm.version", "2").save(folder)
    files = catalogue.files_under(spark, folder)
    return catalogue.matched_sources(catalogue.sessions_of(files), files, _SOURCES)


@query("s2_matched_sources", f"""
WITH {_THERE}
SELECT 'session=session_' || a.slot AS session_id, a.source, CAST(t.slot IS NOT NULL AS BIGINT) AS found_count, t.slot IS NOT NULL AS valid,
  CASE WHEN t.slot IS NOT NULL THEN '' ELSE 'nothing found for ' || a.source END AS message
FROM asked a LEFT JOIN there t ON t.slot = a.slot AND t.source = a.source""")
def s2_matched_sources(spark, sf_dir):
    return _matched(spark, sf_dir).select("session_id", "source", "found_count", "valid", "message")


@query("s3_availability", f"""
WITH {_THERE}
SELECT 'session=session_' || a.slot AS session_id, bool_and(t.slot IS NOT NULL) AS valid,
  coalesce(string_agg(a.source, ',' ORDER BY a.source) FILTER (WHERE t.slot IS NULL), '') AS missing
FROM asked a LEFT JOIN there t ON t.slot = a.slot AND t.source = a.source GROUP BY a.slot""")
def s3_availability(spark, sf_dir):
    return catalogue.availability(_matched(spark, sf_dir)).withColumn("missing", F.array_join("missing", ","))


@query("s3_availability_totals", f"""
WITH {_THERE}, per AS (SELECT a.slot, bool_and(t.slot IS NOT NULL) AS valid FROM asked a LEFT JOIN there t ON t.slot = a.slot AND t.source = a.source GROUP BY a.slot)
SELECT count(*) AS sessions, count(*) FILTER (WHERE valid) AS valid_sessions, round(avg(CASE WHEN valid THEN 100.0 ELSE 0.0 END), 6) AS valid_rate FROM per""")
def s3_availability_totals(spark, sf_dir):
    return rounded(catalogue.availability_totals(catalogue.availability(_matched(spark, sf_dir))), 6, "valid_rate")
