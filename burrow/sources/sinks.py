"""Writing results: session tables, frame tables, walks."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrow.operators.chunks import CHUNK, CHUNK_FRAMES, with_chunk

def session_table(metrics: DataFrame, frame_counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """A row per session with num_frames and one column per metric.

    Metrics with a value per path come as a JSON list in path order. Sessions
    with very many paths are better read from ``path_values``, a row per value.
    """
    entry = F.array_sort(F.collect_list(F.when(F.col("path_id").isNotNull(), F.struct("path_id", "value"))))
    values = F.to_json(F.transform(entry, lambda e: e["value"]))
    single = F.max(F.when(F.col("path_id").isNull(), F.col("value"))).cast("string")
    listed = F.count("path_id") > 0
    cells = metrics.groupBy("session_id", "metric").agg(
        F.when(listed, values).otherwise(single).alias("cell")
    )
    wide = cells.groupBy("session_id").pivot("metric", list(names)).agg(F.first("cell"))
    return frame_counts.join(wide, ["session_id"], "left").select("session_id", "num_frames", *names)


def path_values(metrics: DataFrame) -> DataFrame:
    """The values per path as rows, for lists of any length."""
    return metrics.where("path_id IS NOT NULL").select("session_id", "metric", "path_id", "value")


def write_session_table(table: DataFrame, path: str) -> None:
    table.write.option("header", "true").csv(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The primary form: long Parquet, a folder per metric."""
    metrics.write.partitionBy("metric").parquet(path)


def write_frames(frames: DataFrame, path: str, chunk_frames: int = CHUNK_FRAMES) -> None:
    """Frame table in a folder per session, in frame order within files.

    Rows are dealt by ranges of (session, chunk), so a long session is written by
    many tasks and a short one by one, as one file unless a range ends in it.
    Each task commits its own files, or the driver would move them one by one.
    In a folder of the file system tasks write the files themselves: Hadoop's
    writer starts several processes for each, which for short sessions is most of the work.
    """
    spark = frames.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        frames.transform(with_chunk, "frame_number", chunk_frames)
        .repartitionByRange(ranges, "session_id", CHUNK)
        .sortWithinPartitions("session_id", "frame_number")
        .drop(CHUNK)
    )
    folder = _local_folder(spark, path)
    if folder is None:
        files = dealt.write.partitionBy("session_id")
        files.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
        return
    os.makedirs(folder)  # fails if there is one, like the other writer
    codec = spark.conf.get("spark.sql.parquet.compression.codec").lower()
    codec = {"uncompressed": "none", "lz4_raw": "lz4"}.get(codec, codec)
    session = F.coalesce(F.nullif(F.col("session_id").cast("string"), F.lit("")), F.lit(NO_VALUE))
    rows = dealt.select(session.alias(SESSION), *[F.col(f"`{c}`") for c in frames.columns if c != "session_id"])
    run = uuid.uuid4().hex
    written = rows.mapInArrow(lambda batches: _written(batches, folder, run, codec), "files bigint")
    written.agg(F.sum("files")).collect()
    open(f"{folder}/_SUCCESS", "w").close()


#: The folder of rows without a session, as Spark names it; the folder's column on the way.
NO_VALUE, SESSION = "__HIVE_DEFAULT_PARTITION__", "_burrow_session"
#: Rows of a session that are written at once.
ROWS_AT_ONCE = 250_000
#: What Spark escapes in the name of a partition's folder.
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder in the file system, or nothing if ``path`` is in another store."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.makeQualified(found).toUri().getPath() if store.getUri().getScheme() == "file" else None


def _written(batches: Iterator[pa.RecordBatch], folder: str, run: str, codec: str) -> Iterator[pa.RecordBatch]:
    """Writes rows that are sorted by session. A file gets its name when it is
    whole, and a task that is run again gives it the same name and rows."""
    task = TaskContext.get()
    name, files = f"part-{task.partitionId():05d}-{run}.parquet", 0
    for session, tables in groupby(_runs(batches), key=lambda run: run[0]):
        to = f"{folder}/session_id={_ESCAPED.sub(lambda c: f'%{ord(c[0]):02X}', session)}"
        os.makedirs(to, exist_ok=True)
        part = f"{to}/.{name}.{task.taskAttemptId()}"
        writer, held, rows = None, [], 0
        for _, table in tables:
            held.append(table)
            rows += table.num_rows
            if rows >= ROWS_AT_ONCE:
                writer = writer or pq.ParquetWriter(part, table.schema, compression=codec, store_schema=False)
                writer.write_table(pa.Table.from_batches(held))
                held, rows = [], 0
        if writer is None:
            pq.write_table(pa.Table.from_batches(held), part, compression=codec, store_schema=False)
        else:
            if held:
                writer.write_table(pa.Table.from_batches(held))
            writer.close()
        os.replace(part, f"{to}/{name}")
        files += 1
    yield pa.RecordBatch.from_pydict({"files": [files]})


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """The rows of one session after the other."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.select(batch.schema.names[1:])
        session = batch.column(0).dictionary_encode()
        ends = np.flatnonzero(np.diff(session.indices.to_numpy())) + 1
        for a, b in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows], strict=True):
            yield session[a].as_py(), rows.slice(a, b - a)


def write_walks(walks: DataFrame, statistics: DataFrame, parameters: dict, path: str) -> None:
    """Walks, their statistics and the parameters they were made with, as JSON lines."""
    spark = walks.sparkSession
    walks.write.json(f"{path}/paths")
    statistics.write.json(f"{path}/statistics")
    given = {k: str(v) for k, v in parameters.items() if v is not None}
    spark.createDataFrame([(given,)], "parameters MAP<STRING, STRING>").write.json(f"{path}/parameters")
