"""Reading modality tables: pose, orientation samples, traces, stream metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burrow.functions.projective import is_usable
from burrow.operators.chunks import with_ordinal


_HEADER = ("scorer", "bodyparts", "coords")


def read_pose(spark: SparkSession, path: str, session_of: Column | None = None) -> DataFrame:
    """Pose CSV files with header rows for scorer, bodypart and coordinate, as
    ``session_id, frame_number`` and {bodypart}_{coordinate} columns.

    The header rows may stand in every file but must agree. The session is the
    folder of a file unless ``session_of`` says otherwise.
    """
    raw = spark.read.csv(path).withColumn("_file", F.input_file_name())
    heads = raw.where(F.col("_c0").isin(*_HEADER)).drop("_file").distinct().limit(len(_HEADER) + 1).collect()
    named = {r["_c0"]: r for r in heads}
    if len(heads) > len(named) or not {"bodyparts", "coords"} <= named.keys():
        raise ValueError(f"pose files need one row each of bodyparts and coords, found {sorted(r['_c0'] for r in heads)}")
    cells = [c for c in raw.columns if c not in ("_c0", "_file") and named["bodyparts"][c] is not None]
    values = [F.col(c).cast("double").alias(f"{named['bodyparts'][c]}_{named['coords'][c]}") for c in cells]
    session = F.element_at(F.split("_file", "/"), -2) if session_of is None else session_of
    return raw.where(~F.col("_c0").isin(*_HEADER)).select(
        session.alias("session_id"), F.col("_c0").cast("bigint").alias("frame_number"), *values
    )


def long_pose(wide: DataFrame, bodyparts: Sequence[str] | None = None) -> DataFrame:
    """{bodypart}_x, _y, _likelihood columns as one row per bodypart.

    No bodyparts means all. Unknown names are left out; if all are unknown
    that is an error.
    """
    suffixes = ("_x", "_y", "_likelihood")
    present = [c[:-2] for c in wide.columns if c.endswith("_x") and f"{c[:-2]}_y" in wide.columns]
    chosen = [b for b in bodyparts if b in present] if bodyparts else present
    if not chosen:
        raise ValueError(f"none of {list(bodyparts or [])} is among {present}")
    parts = F.array(
        *[
            F.struct(
                F.lit(b).alias("bodypart"),
                *[
                    (F.col(b + s) if b + s in wide.columns else F.lit(None)).cast("double").alias(s[1:])
                    for s in suffixes
                ],
            )
            for b in chosen
        ]
    )
    keys = [c for c in ("session_id", "frame_number") if c in wide.columns]
    rows = wide.select(*keys, F.explode(parts).alias("_p")).select(*keys, "_p.*")
    # NaN becomes NULL, so that missing means one thing.
    return rows.withColumns({s[1:]: F.nanvl(F.col(s[1:]), F.lit(None).cast("double")) for s in suffixes})


def orientation_samples(samples: DataFrame, order: str = "sample_no") -> DataFrame:
    """Samples with a whole quaternion, numbered per session after the others are dropped."""
    parts = ["qw", "qx", "qy", "qz"]
    missing = [c for c in parts if c not in samples.columns]
    if missing:
        raise ValueError(f"orientation columns not found: {missing}")
    whole = samples.where(" and ".join(f"{c} is not null and not isnan({c})" for c in parts))
    return with_ordinal(whole, ["session_id"], [order], "pos")


def select_traces(
    traces: DataFrame, components: Sequence[str] | None = None, units: Sequence[int] | None = None
) -> DataFrame:
    """Chosen components (None means all, an empty list none) of chosen units."""
    kept = traces if units is None else traces.where(F.col("unit_id").isin(list(units)))
    wanted = ["c", "s"] if components is None else [c.lower() for c in components]
    columns = [c for c in ("c", "s") if c in wanted and c in traces.columns]
    return kept.select("session_id", "unit_id", "frame_number", *columns)


def stream_info(streams: DataFrame) -> DataFrame:
    """Stream metadata with its duration in seconds, 0 for a frame rate of 0 or less."""
    fps = F.col("fps")
    return streams.withColumn("duration", F.when(fps > 0, F.col("frame_count") / fps).otherwise(F.lit(0.0)))


def checked_calibration(calibration: DataFrame) -> DataFrame:
    """Calibration rows; a matrix that cannot be used fails the job, whichever columns are read."""
    message = F.concat(F.lit("unusable calibration matrix of session "), F.col("session_id").cast("string"))
    return calibration.where(F.when(is_usable(F.col("h")), True).otherwise(F.raise_error(message).cast("boolean")))


def split_calibration(calibration: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable matrices, and the rows set aside."""
    usable = is_usable(F.col("h"))
    return calibration.where(usable), calibration.where(~usable)
