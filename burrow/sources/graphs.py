"""Graph files as node and edge tables; each file is one graph.

All readers take many files at once and split them over tasks. Node ids of a
graph become canonical integers when all of them are digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH = "graph_id"
_DATA = "ARRAY<STRUCT<_VALUE: STRING, _key: STRING>>"
_ATTS = "STRUCT<attvalue: ARRAY<STRUCT<_for: STRING, _value: STRING>>>"


def _file_name():
    return F.element_at(F.split(F.input_file_name(), "/"), -1).alias(GRAPH)


def _tagged(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def _canonical(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    plain = nodes.groupBy(GRAPH).agg(F.bool_and(F.col("node_id").rlike(r"^\d+$")).alias("_digits"))

    def fixed(df: DataFrame, *columns: str) -> DataFrame:
        df = df.join(plain, [GRAPH], "left")
        return df.withColumns(
            {c: F.when(F.col("_digits"), F.expr(f"cast(try_cast({c} as decimal(38,0)) as string)")).otherwise(F.col(c)) for c in columns}
        ).drop("_digits")

    return fixed(nodes, "node_id"), fixed(edges, "u", "v")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """GraphML nodes and edges; attributes are maps named as the file's keys say."""
    keys = _tagged(spark, path, "key", "_id STRING, `_attr.name` STRING, _for STRING").select(
        _file_name(), F.col("_id").alias("_key"), F.col("`_attr.name`").alias("_name")
    )
    # A file declares a handful of keys.
    names = keys.groupBy(GRAPH).agg(F.map_from_entries(F.collect_list(F.struct("_key", "_name"))).alias("_names"))

    def attributes(df: DataFrame) -> DataFrame:
        entry = F.transform(
            F.filter("data", lambda d: d["_key"].isNotNull()),
            lambda d: F.struct(F.coalesce(F.col("_names")[d["_key"]], d["_key"]), d["_VALUE"]),
        )
        return df.join(names, [GRAPH], "left").withColumn("attrs", F.map_from_entries(entry)).drop("data", "_names")

    nodes = _tagged(spark, path, "node", f"_id STRING, data {_DATA}").select(_file_name(), F.col("_id").alias("node_id"), "data")
    edges = _tagged(spark, path, "edge", f"_source STRING, _target STRING, data {_DATA}").select(
        _file_name(), F.col("_source").alias("u"), F.col("_target").alias("v"), "data"
    )
    nodes, edges = attributes(nodes), attributes(edges)
    weighted = edges.withColumn("weight", F.expr("try_cast(attrs['weight'] as double)"))
    return _canonical(nodes, weighted)


def read_gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """GEXF nodes and edges; attributes are maps by attribute id."""
    entry = F.transform("attvalues.attvalue", lambda a: F.struct(a["_for"], a["_value"]))
    nodes = _tagged(spark, path, "node", f"_id STRING, _label STRING, attvalues {_ATTS}").select(
        _file_name(), F.col("_id").alias("node_id"), F.col("_label").alias("label"), F.map_from_entries(entry).alias("attrs")
    )
    edges = _tagged(spark, path, "edge", f"_source STRING, _target STRING, _weight DOUBLE, attvalues {_ATTS}").select(
        _file_name(), F.col("_source").alias("u"), F.col("_target").alias("v"), F.map_from_entries(entry).alias("attrs"), F.col("_weight").alias("weight")
    )
    return _canonical(nodes, edges)


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """GML nodes and edges. Records are split at their closing bracket, so a large
    file is read by many tasks; nodes are named by their label, as edges are then."""
    records = spark.read.option("lineSep", "]").text(path).select(_file_name(), "value")

    def block(kind: str) -> DataFrame:
        return records.select(GRAPH, F.regexp_extract("value", rf"(?s)\b{kind}\s*\[(.*)$", 1).alias("_b")).where("_b <> ''")

    def number(name: str):
        return F.regexp_extract("_b", rf"\b{name}\s+(\S+)", 1)

    quoted = F.regexp_extract("_b", r'\blabel\s+"([^"]*)"', 1)
    bare = F.regexp_extract("_b", r"\blabel\s+([^\s\"]+)", 1)
    label = F.when(quoted != "", quoted).when(bare != "", bare).otherwise(number("id"))
    nodes = block("node").select(GRAPH, number("id").alias("_gml"), label.alias("node_id"))
    raw = block("edge").select(GRAPH, number("source").alias("_s"), number("target").alias("_t"), F.expr(r"try_cast(nullif(regexp_extract(_b, '\\bweight\\s+(\\S+)', 1), '') as double)").alias("weight"))
    ends = raw.join(nodes.select(GRAPH, F.col("_gml").alias("_s"), F.col("node_id").alias("u")), [GRAPH, "_s"])
    ends = ends.join(nodes.select(GRAPH, F.col("_gml").alias("_t"), F.col("node_id").alias("v")), [GRAPH, "_t"])
    return _canonical(nodes.drop("_gml"), ends.select(GRAPH, "u", "v", "weight"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = F.trim(F.regexp_replace("value", r"#.*$", ""))
    return spark.read.text(path).select(_file_name(), text.alias("line")).where("line <> ''")


def read_edgelist(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines ``u v`` with an optional ``{'weight': w}`` or a bare weight."""
    parts = F.split("line", r"\s+")
    weight = F.expr(r"try_cast(nullif(regexp_extract(line, '^\\S+\\s+\\S+\\s+(?:\\{.*.weight.\\s*:\\s*)?([-+0-9.eE]+)', 1), '') as double)")
    edges = _lines(spark, path).where(F.size(parts) >= 2).select(
        GRAPH, parts[0].alias("u"), parts[1].alias("v"), weight.alias("weight")
    )
    return _canonical(_ends(edges), edges)


def read_adjlist(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines ``u v1 v2 …``; a line of one id is a lone node."""
    parts = F.split("line", r"\s+")
    rows = _lines(spark, path).select(GRAPH, parts[0].alias("u"), F.slice(parts, 2, F.size(parts)).alias("_vs"))
    edges = rows.select(GRAPH, "u", F.explode("_vs").alias("v"))
    nodes = _ends(edges).unionByName(rows.select(GRAPH, F.col("u").alias("node_id"))).distinct()
    return _canonical(nodes, edges)


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(GRAPH, F.explode(F.array("u", "v")).alias("node_id")).distinct()


READERS = {
    "graphml": read_graphml,
    "gexf": read_gexf,
    "gml": read_gml,
    "edgelist": read_edgelist,
    "adjlist": read_adjlist,
}


def read_graphs(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    if kind not in READERS:
        raise ValueError(f"unknown graph format {kind!r}, known: {sorted(READERS)}")
    return READERS[kind](spark, path)
