"""Maps: which regions belong to which graph elements, as documents and as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrow.functions import geometry as G
from burrow.operators.locate import MAP, edge_key

VERSION = 3.0
_OUTLINES = "MAP<STRING, ARRAY<ARRAY<ARRAY<DOUBLE>>>>"
DOCUMENT = (
    "format_version STRING, graph_builder STRUCT<type: STRING, config: MAP<STRING, STRING>>, "
    f"mappings STRUCT<nodes: {_OUTLINES}, edges: {_OUTLINES}>, metadata MAP<STRING, STRING>"
)
NO_SHAPE = {c: "CAST(NULL AS DOUBLE)" for c in ("cx", "cy", "a", "b", "angle")}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Map documents, one per file, with the file name as map_id."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return spark.read.schema(DOCUMENT).option("multiLine", "true").json(path).withColumn(MAP, name)


def regions_of_documents(documents: DataFrame) -> DataFrame:
    """Region rows in file order, nodes before edges.

    Fails while reading: a version under 3, no mapped element at all, an edge
    name that is not two ids, an outline of fewer than three points.
    """
    version = F.expr("try_cast(format_version as double)")
    size = F.coalesce(F.size("mappings.nodes"), F.lit(0)) + F.coalesce(F.size("mappings.edges"), F.lit(0))
    fault = (
        F.when(version.isNull() | (version < VERSION), F.lit("needs version 3.0 or later"))
        .when(F.col("mappings").isNull() | (size <= 0), F.lit("holds no mappings"))
    )
    message = F.concat(F.lit("map "), F.col(MAP), F.lit(" "), fault)
    checked = documents.withColumn("mappings", F.when(fault.isNull(), F.col("mappings")).otherwise(F.raise_error(message)))
    parts = []
    for rank, (field, kind) in enumerate((("nodes", "node"), ("edges", "edge"))):
        elements = checked.select(
            MAP, F.posexplode(F.map_entries(f"mappings.{field}")).alias("_at", "_e")
        ).select(MAP, "_at", F.col("_e.key").alias("_name"), F.col("_e.value").alias("_outlines"))
        parts.append(
            elements.select(MAP, "_at", "_name", F.posexplode("_outlines").alias("_i", "_points")).select(
                MAP,
                "_name",
                F.struct(F.lit(rank).alias("kind"), F.col("_at").alias("element"), F.col("_i").alias("outline")).alias("ord"),
                F.concat(F.lit(f"{kind}_"), "_name", F.lit("_region_"), F.col("_i")).alias("region_id"),
                F.lit(kind).alias("element_type"),
                "_points",
            )
        )
    rows = parts[0].unionByName(parts[1])
    ends = F.split("_name", "_")
    is_edge = F.col("element_type") == "edge"
    bad_edge = is_edge & (F.size(ends) != 2)
    enough = F.size("_points") >= 3
    points = F.transform("_points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return rows.select(
        MAP,
        "ord",
        "region_id",
        F.lit("polygon").alias("kind"),
        F.when(enough, points).otherwise(F.raise_error(F.concat(F.lit("outline needs three points: "), "region_id"))).alias("points"),
        *[F.expr(sql).alias(c) for c, sql in NO_SHAPE.items()],
        "element_type",
        F.when(~is_edge, F.col("_name")).alias("node_id"),
        F.when(bad_edge, F.raise_error(F.concat(F.lit("edge name needs two ids: "), "_name"))).when(is_edge, ends[0]).alias("u"),
        F.when(is_edge, F.get(ends, F.lit(1))).alias("v"),
    )


def unknown_elements(regions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Mapped elements that the graph does not have; tables carry map_id."""
    strange = (
        regions.where("element_type = 'node'")
        .join(nodes.select(MAP, "node_id"), [MAP, "node_id"], "left_anti")
        .select(MAP, "element_type", F.col("node_id").alias("element"))
    )
    known = edges.select(MAP, edge_key().alias("_e"))
    odd = (
        regions.where("element_type = 'edge'")
        .withColumn("_e", edge_key())
        .join(known, [MAP, "_e"], "left_anti")
        .select(MAP, "element_type", F.concat_ws("-", "u", "v").alias("element"))
    )
    return strange.unionByName(odd).distinct()


def repeated_regions(regions: DataFrame) -> DataFrame:
    """Region ids that stand for more than one node."""
    nodes = regions.where("element_type = 'node'").select(MAP, "region_id", "node_id").distinct()
    return nodes.groupBy(MAP, "region_id").agg(F.count("*").alias("nodes")).where("nodes > 1")


# -- writing --------------------------------------------------------------------

def summary(regions: DataFrame) -> DataFrame:
    """One row per region of a measured map, as the summary CSV holds it."""
    element = F.when(F.col("element_type") == "edge", F.concat_ws("-", "u", "v")).otherwise(F.col("node_id"))
    return regions.select(
        MAP,
        "region_id",
        "element_type",
        element.alias("element_id"),
        F.col("kind").alias("region_type"),
        "center_x",
        "center_y",
        "area",
    )


def write_summary(regions: DataFrame, path: str) -> None:
    summary(regions).write.option("header", "true").csv(path)


def write_regions(regions: DataFrame, path: str) -> None:
    """All shapes of all maps, one JSON line per region."""
    kept = [c for c in regions.columns if c not in G.MEASURES]
    regions.select(*kept).write.json(path)


def read_regions(spark: SparkSession, path: str, ord_type: str = "BIGINT") -> DataFrame:
    schema = (
        f"map_id STRING, ord {ord_type}, region_id STRING, kind STRING, points ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>, "
        "cx DOUBLE, cy DOUBLE, a DOUBLE, b DOUBLE, angle DOUBLE, element_type STRING, node_id STRING, u STRING, v STRING"
    )
    return spark.read.schema(schema).json(path)


def documents(regions: DataFrame, builders: DataFrame | None = None) -> DataFrame:
    """One map document per map, outlines only: rectangles become four points.

    A document is one value that one task makes; write_regions writes a line
    per region, for maps of any size, and also keeps circles and ellipses.
    """
    x, y, a, b = (F.col(c) for c in ("cx", "cy", "a", "b"))
    corners = F.array(F.array(x, y), F.array(x + a, y), F.array(x + a, y + b), F.array(x, y + b))
    outline = F.when(F.col("kind") == "polygon", F.transform("points", lambda p: F.array(p["x"], p["y"]))).when(
        F.col("kind") == "rectangle", corners
    )
    name = F.when(F.col("element_type") == "edge", F.concat_ws("_", "u", "v")).otherwise(F.col("node_id"))
    rows = regions.select(MAP, "ord", "element_type", name.alias("_name"), outline.alias("_outline")).where("_outline is not null")
    per = rows.groupBy(MAP, "element_type", "_name").agg(
        F.min("ord").alias("_at"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "_outline"))), lambda r: r["_outline"]).alias("_outlines")
    )

    def side(kind: str):
        entries = F.array_sort(F.collect_list(F.when(F.col("element_type") == kind, F.struct("_at", "_name", "_outlines"))))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["_name"], e["_outlines"]))).alias(kind + "s")

    docs = per.groupBy(MAP).agg(side("node"), side("edge"))
    docs = docs.select(
        MAP,
        F.lit(str(VERSION)).alias("format_version"),
        F.struct("nodes", "edges").alias("mappings"),
        F.create_map(
            F.lit("total_nodes"), F.size("nodes").cast("string"), F.lit("total_edges"), F.size("edges").cast("string")
        ).alias("metadata"),
    )
    if builders is not None:
        docs = docs.join(builders.select(MAP, F.struct(F.col("builder").alias("type"), F.col("params").alias("config")).alias("graph_builder")), [MAP], "left")
    return docs
