"""The live operators over timed frames, read as a stream of files in order of arrival."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burrow.operators.chunks import with_ordinal
from burrow.plans.path_queries import _ROWS, ERROR, PURCHASE, paths_sql
from burrow.plans.registry import query
from burrow.plans.standins import table, with_ctes
from burrow.session import materialise, work_folder
from burrow.streaming import live


#: Arrival is cut into so many slices; a frame arrives up to LATE_HOURS after its time.
SLICES, LATE_HOURS, FILES = 10, 12, 8
_hours = 30 * 24 / SLICES
#: What a file that is read early may hold back, and the lateness.
DELAY = f"{_hours + LATE_HOURS:.0f} hours"


def _arrivals(spark, sf_dir) -> str:
    """Folder of the timed frames, written slice by slice as they arrive.

    Every third frame is late by a share of LATE_HOURS. A heartbeat behind the
    last slice lets the last frames out.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _folders:
        arrived = materialise(_timed(spark, sf_dir), "arrivals")
        span = arrived.agg(F.min("_arrival").alias("low"), F.max("_arrival").alias("high"), F.max("ts").alias("last")).first()
        folder = f"{work_folder(spark)}/live-in-{uuid.uuid4().hex}"
        slot = F.least(F.floor((F.col("_arrival") - span.low) * SLICES / F.greatest(F.lit(span.high - span.low), F.lit(1))), F.lit(SLICES - 1))
        for k in range(SLICES):  # the stream reads files by their time of writing
            # As many files as a batch reads at most, so that the batches don't grow with the input.
            arrived.where(slot == k).drop("_arrival").coalesce(FILES).write.mode("append").parquet(folder)
        late = F.lit(span.last) + F.expr("INTERVAL 60 DAYS")
        beat = arrived.limit(1).withColumns({"frame_number": F.lit(None).cast("bigint"), "ts": late}).drop("_arrival")
        beat.write.mode("append").parquet(folder)
        _folders[key] = folder
    return _folders[key]


def _timed(spark, sf_dir) -> DataFrame:
    """The numbered frames with their time, and the second of their arrival."""
    numbered = with_ordinal(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])
    late = F.when(F.col("event_id") % 3 == 0, F.pmod(F.xxhash64("event_id"), F.lit(LATE_HOURS * 3600))).otherwise(0)
    return numbered.select(
        F.col("user_id").alias("session_id"), "frame_number", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("state"), F.col("value").alias("x"),
        (F.unix_seconds(F.col("ts").cast("timestamp")) + late).alias("_arrival"),
    )


_folders: dict[tuple[str, str], str] = {}


def _stream(spark, sf_dir) -> DataFrame:
    folder = _arrivals(spark, sf_dir)
    stored = spark.read.parquet(folder)
    return spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", FILES).parquet(folder)


def _drained(spark, df: DataFrame) -> DataFrame:
    """Run a stream over what is there, into a table, and read that."""
    out = f"{work_folder(spark)}/live-{uuid.uuid4().hex}"
    query = (
        df.writeStream.format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


@query("st1_live_transitions", paths_sql(ERROR, PURCHASE, _ROWS))
def st1_live_transitions(spark, sf_dir):
    return _drained(spark, live.live_transitions(_stream(spark, sf_dir), "state", "error", "state", "purchase", delay=DELAY))


@query("st2_live_window", with_ctes("frames") + """
SELECT session_id, frame_number, x AS value, round(lo - CASE WHEN lo <> hi THEN (hi - lo) * 0.1 ELSE 1.0 END, 5) AS y_low,
  round(hi + CASE WHEN lo <> hi THEN (hi - lo) * 0.1 ELSE 1.0 END, 5) AS y_high
FROM (SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi FROM frames
      WINDOW w AS (PARTITION BY session_id ORDER BY frame_number ROWS BETWEEN 149 PRECEDING AND CURRENT ROW))""")
def st2_live_window(spark, sf_dir):
    out = _drained(spark, live.live_window(_stream(spark, sf_dir), "x", delay=DELAY))
    return out.withColumns({c: F.round(c, 5) for c in ("y_low", "y_high")})
