"""The given tables read as sessions, frames, poses, traces, regions and graphs.

Each reader has a DuckDB twin in ``CTE`` with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrow.functions.geometry import measured
from burrow.operators.chunks import with_ordinal
from burrow.session import materialise

_stored: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ingested(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Frame tables are numbered once per application and then read back."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = materialise(build(), name)
    return _stored[key]


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        numbered = with_ordinal(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])
        k = F.get_json_object("props", "$.k").cast("bigint")
        return numbered.select(
            F.col("user_id").alias("session_id"),
            "frame_number",
            F.col("event_type").alias("state"),
            F.col("value").alias("x"),
            k.cast("double").alias("y"),
            (k % 10).alias("node"),
        )

    return _ingested(spark, sf_dir, "frames", build)


def pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long pose table: three bodyparts per frame."""

    def build():
        order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
        items = table(spark, sf_dir, "lineitem").select(
            "l_suppkey", *order, "l_quantity", "l_discount", "l_tax"
        )
        numbered = with_ordinal(items, ["l_suppkey"], order, "rn")
        return numbered.select(
            F.col("l_suppkey").alias("session_id"),
            F.floor(F.col("rn") / 3).alias("frame_number"),
            F.element_at(F.array(*map(F.lit, "ABC")), (F.col("rn") % 3 + 1).cast("int")).alias("bodypart"),
            F.col("l_quantity").alias("x"),
            F.round(F.col("l_discount") * 1000, 6).alias("y"),
            F.round(F.col("l_tax") * 10, 6).alias("likelihood"),
        )

    return _ingested(spark, sf_dir, "pose", build)


def imu(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        part = [F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("qw", "qx", "qy", "qz"))]
        rows = table(spark, sf_dir, "embeddings").select(
            F.col("label").alias("session_id"), F.col("vec_id").alias("sample_no"), *part
        )
        return with_ordinal(rows, ["session_id"], ["sample_no"], "pos")

    return _ingested(spark, sf_dir, "imu", build)


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long traces: one row per (session, unit, frame); frames are dense per session."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.lit(0).cast("bigint").alias("session_id"),
        F.col("vec_id").cast("bigint").alias("frame_number"),
        F.posexplode("embedding").alias("unit_id", "c"),
    )
    return rows.select("session_id", F.col("unit_id").cast("bigint").alias("unit_id"), "frame_number",
                       F.col("c").cast("double").alias("c"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metadata row per session, read from the customer that owns it."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("session_id"),
        F.when(key % 7 == 0, None).otherwise((20 + key % 4 * 10).cast("double")).alias("fps"),
        (key * 10).cast("bigint").alias("frame_count"),
        F.when(key % 3 == 0, None).otherwise(0.001 * (key % 5 + 1)).alias("pixel_to_meter"),
    )


KINDS = ("rectangle", "polygon", "circle", "ellipse", "hexagon")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About twenty regions on the map of every session, one per part, measured once."""
    return _ingested(spark, sf_dir, "regions", lambda: measured(_regions(spark, sf_dir)))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier").select(F.count("*")).scalar()
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").withColumn("_n", n)
    slot = F.floor(k / F.col("_n"))
    x, y = 0.125 + F.col("p_size"), 0.375 + (slot * 37 + k * 11) % 100
    a, b = 3.0 + k % 5 * 1.5, 2.0 + k % 3 * 2.25
    corner = [(x - a, y - b), (x + a, y - b), (x + a, y + b), (x, y - b / 2), (x - a, y + b)]
    is_node = F.col("p_size") % 3 != 0
    return rows.select(
        (k % F.col("_n")).alias("map_id"),
        k.alias("ord"),
        F.concat(F.lit("region_"), k).alias("region_id"),
        F.element_at(F.array(*map(F.lit, KINDS)), ((F.col("p_size") + k) % 5 + 1).cast("int")).alias("kind"),
        F.array(*[F.struct(px.alias("x"), py.alias("y")) for px, py in corner]).alias("points"),
        x.alias("cx"),
        y.cast("double").alias("cy"),
        a.alias("a"),
        b.alias("b"),
        (k % 4 * 0.3).alias("angle"),
        F.when(is_node, "node").otherwise("edge").alias("element_type"),
        F.when(is_node, F.concat(F.lit("P"), k)).alias("node_id"),
        F.when(~is_node, F.concat(F.lit("P"), k)).alias("u"),
        F.when(~is_node, F.concat(F.lit("P"), k + F.col("_n"))).alias("v"),
    )


CTE = {
    "frames": """frames AS (
  SELECT user_id AS session_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_number,
         event_type AS state, value AS x,
         CAST(json_extract(props, '$.k') AS DOUBLE) AS y,
         CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS node
  FROM events)""",
    "pose": """pose AS (
  SELECT l_suppkey AS session_id, rn // 3 AS frame_number,
         CASE rn % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS bodypart,
         l_quantity AS x, round(l_discount * 1000, 6) AS y, round(l_tax * 10, 6) AS likelihood
  FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey,
               l_linenumber, l_partkey, l_extendedprice) - 1 AS rn FROM lineitem))""",
    "imu": """imu AS (
  SELECT label AS session_id, vec_id AS sample_no,
         CAST(embedding[1] AS DOUBLE) AS qw, CAST(embedding[2] AS DOUBLE) AS qx,
         CAST(embedding[3] AS DOUBLE) AS qy, CAST(embedding[4] AS DOUBLE) AS qz,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos
  FROM embeddings)""",
    "traces": """traces AS (
  SELECT CAST(0 AS BIGINT) AS session_id, CAST(vec_id AS BIGINT) AS frame_number,
         CAST(i - 1 AS BIGINT) AS unit_id, CAST(embedding[i] AS DOUBLE) AS c
  FROM embeddings, range(1, 65) AS r(i))""",
    "regions": """raw_regions AS (
  SELECT p_partkey % n AS map_id, p_partkey AS ord, 'region_' || p_partkey AS region_id,
         ['rectangle', 'polygon', 'circle', 'ellipse', 'hexagon'][CAST((p_size + p_partkey) % 5 + 1 AS INTEGER)] AS kind,
         CAST(0.125 + p_size AS DOUBLE) AS cx, CAST(0.375 + ((p_partkey // n) * 37 + p_partkey * 11) % 100 AS DOUBLE) AS cy,
         CAST(3.0 + p_partkey % 5 * 1.5 AS DOUBLE) AS a, CAST(2.0 + p_partkey % 3 * 2.25 AS DOUBLE) AS b,
         CAST(p_partkey % 4 AS DOUBLE) * CAST(0.3 AS DOUBLE) AS angle,
         CASE WHEN p_size % 3 <> 0 THEN 'node' ELSE 'edge' END AS element_type,
         CASE WHEN p_size % 3 <> 0 THEN 'P' || p_partkey END AS node_id,
         CASE WHEN p_size % 3 = 0 THEN 'P' || p_partkey END AS u,
         CASE WHEN p_size % 3 = 0 THEN 'P' || (p_partkey + n) END AS v
  FROM part, (SELECT count(*) AS n FROM supplier)),
corners AS (
  SELECT map_id, region_id, i, 6 AS c, cx + a * cos(CAST(i - 1 AS DOUBLE) * (pi() / 3)) AS x, cy + a * sin(CAST(i - 1 AS DOUBLE) * (pi() / 3)) AS y
  FROM raw_regions, range(1, 7) AS r(i) WHERE kind = 'hexagon'
  UNION ALL
  SELECT map_id, region_id, i, 5, [cx - a, cx + a, cx + a, cx, cx - a][i], [cy - b, cy - b, cy + b, cy - b / 2, cy + b][i]
  FROM raw_regions, range(1, 6) AS r(i) WHERE kind = 'polygon'),
sides AS (
  SELECT p.map_id, p.region_id, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2
  FROM corners p JOIN corners q ON q.region_id = p.region_id AND q.i = p.i % p.c + 1),
outline AS (
  SELECT region_id, sum(x1 * y2 - x2 * y1) AS s, sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS sx,
         sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS sy, min(x1) AS mnx, max(x1) AS mxx, min(y1) AS mny, max(y1) AS mxy
  FROM sides GROUP BY region_id),
regions AS (
  SELECT r.*,
    CASE kind WHEN 'polygon' THEN mnx WHEN 'rectangle' THEN cx WHEN 'ellipse' THEN cx - sqrt((a*cos(angle))**2 + (b*sin(angle))**2) ELSE cx - a END AS x0,
    CASE kind WHEN 'polygon' THEN mxx WHEN 'ellipse' THEN cx + sqrt((a*cos(angle))**2 + (b*sin(angle))**2) ELSE cx + a END AS x1,
    CASE kind WHEN 'polygon' THEN mny WHEN 'rectangle' THEN cy WHEN 'circle' THEN cy - a WHEN 'hexagon' THEN cy - a * sqrt(3.0) / 2
      ELSE cy - sqrt((a*sin(angle))**2 + (b*cos(angle))**2) END AS y0,
    CASE kind WHEN 'polygon' THEN mxy WHEN 'rectangle' THEN cy + b WHEN 'circle' THEN cy + a WHEN 'hexagon' THEN cy + a * sqrt(3.0) / 2
      ELSE cy + sqrt((a*sin(angle))**2 + (b*cos(angle))**2) END AS y1,
    CASE kind WHEN 'polygon' THEN sx / (3 * s) WHEN 'rectangle' THEN cx + a / 2 ELSE cx END AS center_x,
    CASE kind WHEN 'polygon' THEN sy / (3 * s) WHEN 'rectangle' THEN cy + b / 2 ELSE cy END AS center_y,
    CASE kind WHEN 'polygon' THEN abs(s) / 2 WHEN 'rectangle' THEN a * b WHEN 'circle' THEN pi() * a * a
      WHEN 'hexagon' THEN 1.5 * sqrt(3.0) * a * a ELSE pi() * a * b END AS area
  FROM raw_regions r LEFT JOIN outline o ON o.region_id = r.region_id)""",
    "sessions": """sessions AS (
  SELECT c_custkey AS session_id,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(20 + c_custkey % 4 * 10 AS DOUBLE) END AS fps,
         CAST(c_custkey * 10 AS BIGINT) AS frame_count,
         CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(0.001 AS DOUBLE) * (c_custkey % 5 + 1) END AS pixel_to_meter
  FROM customer)""",
}


def with_ctes(*names: str, recursive: bool = False, extra: str = "") -> str:
    parts = [CTE[n] for n in names] + ([extra] if extra else [])
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
