"""Which sessions there are under an experiment folder, and what files they hold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrow.operators.metrics import natural_key
from burrow.session import materialise

# Folder names under an experiment root that are not sessions.
NOT_SESSIONS = (
    "shared_resources", "shared", "resources", "output", "results", "analysis", ".git", "__pycache__", ".mypy_cache",
)
SHARED_FOLDER = "resources"


def files_under(spark: SparkSession, root: str) -> DataFrame:
    """(folder, entry, path, length, modificationTime) of every file below ``root``.

    ``entry`` is the file or sub-folder directly in ``folder``. File contents
    are not read. The list is made once and kept as a table, because whoever
    reads it again would ask for every file's status again.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length", "modificationTime")
    )
    base = root.rstrip("/").split("://")[-1].split(":")[-1]
    inner = F.substring_index(F.col("path"), base + "/", -1)
    parts = F.split(inner, "/")
    found = files.withColumns({"_parts": parts}).where(F.size("_parts") >= 2).select(
        F.col("_parts")[0].alias("folder"), F.col("_parts")[1].alias("entry"), "path", "length", "modificationTime"
    )
    return materialise(found, "files")


def folders_under(spark: SparkSession, root: str) -> DataFrame:
    """(folder) of every folder directly in ``root``, also those without files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [(s.getPath().getName(),) for s in listed if s.isDirectory()]
    return spark.createDataFrame(names, "folder string")


def sessions_of(files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Session folders with their natural sort key; no session at all is an error.

    ``folders`` adds sessions whose folder has no file; no source matches there.
    """
    names = files.select("folder")
    names = names if folders is None else names.unionByName(folders.select("folder"))
    names = names.select(F.col("folder").alias("session_id")).distinct()
    kept = names.where(~F.col("session_id").isin(*NOT_SESSIONS) & ~F.col("session_id").startswith("."))
    if kept.isEmpty():
        raise ValueError("no session folders found")
    return kept.withColumn("sort_key", natural_key("session_id"))


def matched_sources(sessions: DataFrame, files: DataFrame, specs: Sequence[Mapping]) -> DataFrame:
    """For each session and source: how many entries match, and the one to use.

    A spec has ``source`` and either ``pattern`` (searched in entry names without
    regard to case; in the shared folder if ``shared``) or ``path``. Among
    several matches the smallest path is used.
    """
    out = None
    for spec in specs:
        if spec.get("path"):
            named = spec["path"].lstrip("/")
            hits = files.where((F.col("path") == spec["path"]) | F.col("path").endswith(f"/{named}")).select(F.lit(None).cast("string").alias("folder"), "entry", "path")
            shared = True
        else:
            shared = bool(spec.get("shared"))
            hits = files.where(F.col("entry").rlike(f"(?i){spec['pattern']}"))
            hits = hits.where(F.col("folder") == SHARED_FOLDER) if shared else hits
        picked = [F.count_distinct("entry").alias("found_count"), F.min("path").alias("path")]
        if shared:
            count, path = (hits.select(p).scalar() for p in picked)
            part = sessions.select("session_id").withColumns({"found_count": count, "path": path})
        else:
            per = hits.groupBy(F.col("folder").alias("session_id")).agg(*picked)
            part = sessions.select("session_id").join(per, "session_id", "left")
        part = part.select(
            "session_id",
            F.lit(spec["source"]).alias("source"),
            F.coalesce("found_count", F.lit(0).cast("bigint")).alias("found_count"),
            "path",
        )
        out = part if out is None else out.unionByName(part)
    valid = F.col("found_count") > 0
    return out.withColumns(
        {"valid": valid, "message": F.when(valid, "").otherwise(F.concat(F.lit("nothing found for "), "source"))}
    )


def availability(matched: DataFrame) -> DataFrame:
    """Per session: whether every source was found, and which were not."""
    return matched.groupBy("session_id").agg(
        F.bool_and("valid").alias("valid"),
        F.array_sort(F.collect_set(F.when(~F.col("valid"), F.col("source")))).alias("missing"),
    )


def availability_totals(report: DataFrame) -> DataFrame:
    """Sessions in all, valid ones and their share in percent (0 without sessions)."""
    return report.agg(
        F.count("*").alias("sessions"),
        F.count_if("valid").alias("valid_sessions"),
        F.coalesce(F.avg(F.col("valid").cast("int")) * 100, F.lit(0.0)).alias("valid_rate"),
    )
