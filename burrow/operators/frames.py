"""Masking, projecting and aligning the modalities on the frame axis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burrow.functions import angles as A
from burrow.functions.projective import inverse, project
from burrow.operators.chunks import CHUNK_FRAMES, chunk_window, keep_home, same_keys, with_halo
from burrow.operators.skew import salted_join
from burrow.session import materialise

LIKELIHOOD = 0.3
KEYS = ("session_id",)
FRAME = "frame_number"


def no_nan(df: DataFrame, *columns: str) -> DataFrame:
    """NaN becomes NULL, so that missing means one thing."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in columns})


def mask_unlikely(
    pose: DataFrame, threshold: float = LIKELIHOOD, per_bodypart: Mapping[str, float] | None = None
) -> DataFrame:
    """Drop coordinates whose likelihood is under the threshold; keep the likelihood.

    A threshold of zero or less masks nothing, nor does a missing likelihood.
    """
    limit = F.lit(float(threshold))
    if per_bodypart:
        chosen = F.lit(None).cast("double")
        for part, value in per_bodypart.items():
            chosen = F.when(F.col("bodypart") == part, F.lit(float(value))).otherwise(chosen)
        limit = F.coalesce(chosen, limit)
    hidden = (limit > 0) & (F.col("likelihood") < limit)
    return pose.withColumns({c: F.when(hidden, None).otherwise(F.col(c)) for c in ("x", "y")})


def coverage(df: DataFrame, column: str, by: Sequence[str], low: float = 50.0) -> DataFrame:
    """Share of rows with a value, in percent, and whether it is low."""
    share = F.avg(F.col(column).isNotNull().cast("int")) * 100
    return df.groupBy(*by).agg(share.alias("coverage")).withColumn("is_low", F.col("coverage") < low)


def _with_matrix(df: DataFrame, calibration: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(calibration.select(*keys, F.col("h").alias("_h")), list(keys), "left")


def to_map(
    df: DataFrame,
    calibration: DataFrame,
    x="x",
    y="y",
    names=("map_x", "map_y"),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Camera to map coordinates by each session's homography."""
    px, py = project(F.col("_h"), F.col(x), F.col(y))
    return _with_matrix(df, calibration, keys).withColumns({names[0]: px, names[1]: py}).drop("_h")


def to_camera(
    df: DataFrame,
    calibration: DataFrame,
    width: float,
    height: float,
    x="map_x",
    y="map_y",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Map to camera coordinates, and whether they fall in the picture (borders count)."""
    backward = calibration.select(*keys, inverse(F.col("h")).alias("h"))
    px, py = project(F.col("_h"), F.col(x), F.col(y))
    moved = _with_matrix(df, backward, keys).withColumns({"camera_x": px, "camera_y": py}).drop("_h")
    inside = F.col("camera_x").between(0, width) & F.col("camera_y").between(0, height)
    return moved.withColumn("in_view", F.coalesce(inside, F.lit(False)))


def on_map(df: DataFrame, width: float, height: float, threshold: float | None = None, x="x", y="y") -> DataFrame:
    """Rows on the map picture (upper borders excluded) that are likely enough."""
    px, py = F.col(x), F.col(y)
    kept = df.where((px >= 0) & (px < width) & (py >= 0) & (py < height))
    if threshold is not None and "likelihood" in df.columns:
        kept = kept.where(F.col("likelihood").isNull() | (F.col("likelihood") >= threshold))
    return kept


def current_element(df: DataFrame, columns: Sequence[str], name: str = "current") -> DataFrame:
    """First value present among the given columns."""
    return df.withColumn(name, F.coalesce(*[F.col(c) for c in columns]))


def same_edge(u1: Column, v1: Column, u2: Column, v2: Column) -> Column:
    """Edge equality in either direction."""
    return F.array_sort(F.array(u1, v1)) == F.array_sort(F.array(u2, v2))


def derived_bodypart(pose: DataFrame, name: str, sources: Sequence[str], function: str = "centroid") -> DataFrame:
    """Add a bodypart at the mean of others; its likelihood is the smallest of theirs.

    The likelihoods come unmasked, as mask_unlikely leaves them.
    """
    if function != "centroid":
        raise ValueError(f"unknown derived bodypart function {function!r}")
    if not sources:
        return pose
    made = (
        no_nan(pose.where(F.col("bodypart").isin(*sources)), "x", "y", "likelihood")
        .groupBy("session_id", FRAME)
        .agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.min("likelihood").alias("likelihood"))
        .withColumn("bodypart", F.lit(name))
    )
    return pose.unionByName(made)


def wide_pose(pose: DataFrame, bodyparts: Sequence[str]) -> DataFrame:
    """One row per frame with {bodypart}_x, _y and _likelihood."""
    cells = [
        F.max(F.when(F.col("bodypart") == b, F.col(c))).alias(f"{b}_{c}")
        for b in bodyparts
        for c in ("x", "y", "likelihood")
    ]
    return pose.where(F.col("bodypart").isin(*bodyparts)).groupBy("session_id", FRAME).agg(*cells)


def align_sampled(frames: DataFrame, samples: DataFrame, skip: int, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Frame i takes sample i·skip of its session, NULL past the end."""
    picked = samples.select(*keys, *columns, F.col("pos").alias("_pos")).where(F.col("_pos") % skip == 0)
    picked = picked.withColumn(FRAME, F.floor(F.col("_pos") / skip)).drop("_pos")
    return frames.join(picked, [*keys, FRAME], "left")


def head_orientation(samples: DataFrame, offset: float | None = None, direction: float | None = None) -> DataFrame:
    """yaw, pitch and roll of each sample; yaw is calibrated when an offset is given."""
    turned = A.quaternion_angles(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    if offset is not None:
        turned["yaw"] = A.calibrated_yaw(turned["yaw"], offset, A.YAW_DIRECTION if direction is None else direction)
    return samples.withColumns(turned)


def align_by_position(frames: DataFrame, series: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Join a series on the frame ordinal: longer series are cut, shorter end in NULL."""
    return frames.join(series.select(*keys, FRAME, *columns), [*keys, FRAME], "left")


def assemble(pose_frames: DataFrame, sources: Sequence[tuple[DataFrame | None, Sequence[str], bool]], keys: Sequence[str] = KEYS) -> DataFrame:
    """Frame table: the pose frames with the columns of every further source.

    Each source is (table, columns, required). A missing table stops the
    assembly when it is required and is passed over when it is not.
    """
    out = pose_frames
    for series, columns, required in sources:
        if series is None or any(c not in series.columns for c in columns):
            if required:
                raise ValueError(f"required source lacks {list(columns)}")
            continue
        out = align_by_position(out, series, columns, keys)
    return out


def clamped_frame(frame: Column, count: Column) -> Column:
    """Frame of another recording: its first or last frame outside its range."""
    return F.least(F.greatest(frame, F.lit(0).cast("bigint")), count - 1)


def mean_over_units(traces: DataFrame, function: str = "mean", keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean calcium over all units of a frame, missing values left out."""
    if function != "mean":
        raise ValueError(f"unknown derived trace function {function!r}")
    return no_nan(traces, "c").groupBy(*keys, FRAME).agg(F.avg("c").alias("mean_c"))


def modulated_footprints(frames: DataFrame, traces: DataFrame, contours: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Contour and activity of every unit in every frame; no activity counts as 0.

    Each frame meets the units of its own session; long sessions are salted. Only
    frames are joined by shuffle, with their active units as an array: pairs of a
    frame and a unit arise behind that, and get their contour where they arise.
    """
    keys = list(keys)
    contours = materialise(contours.select(*keys, "unit_id", "contour"), "contours")
    # In structs, because lists leave out a bare NULL.
    listed = F.transform(F.collect_list(F.struct("unit_id")), lambda s: s["unit_id"])
    units = contours.groupBy(*keys).agg(F.array_distinct(listed).alias("_units"))
    entry = F.struct("unit_id", F.coalesce("c", F.lit(0.0)).alias("activity"))
    active = traces.where("unit_id IS NOT NULL").groupBy(*keys, FRAME).agg(F.collect_list(entry).alias("_active"))
    grown = salted_join(frames.select(*keys, FRAME).join(active, [*keys, FRAME], "left"), units, keys, [FRAME])
    seen = F.coalesce("_active", F.array().cast(active.schema["_active"].dataType))
    silent = F.transform(
        F.array_except("_units", F.transform(seen, lambda s: s["unit_id"])),
        lambda u: F.struct(u.alias("unit_id"), F.lit(0.0).alias("activity")),
    )
    pairs = grown.select(*keys, FRAME, F.inline(F.concat(seen, silent)))
    met = pairs.alias("a").join(contours.alias("b"), same_keys([*keys, "unit_id"]))
    return met.select(*[f"a.{k}" for k in keys], f"a.{FRAME}", "a.unit_id", "contour", "activity")


def footprint_mask(footprints: DataFrame, percentile: float = 50.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pixels of each unit above the percentile of its non-zero 8-bit levels.

    Levels take at most 256 values, so the percentile is read off their counts.
    """
    unit = [*keys, "unit_id"]
    span = footprints.groupBy(*unit).agg(F.min("w").alias("_min"), F.max("w").alias("_max"))
    lifted = F.col("w") - F.col("_min")
    level = F.floor(lifted / (F.col("_max") - F.col("_min")) * 255).cast("int")
    levels = (
        footprints.join(span.where("_max > _min"), unit)
        .withColumn("level", level)
        .drop("_min", "_max")
    )
    counts = levels.where("level > 0").groupBy(*unit, "level").agg(F.count("*").alias("_n"))
    cut = counts.groupBy(*unit).agg(
        F.percentile("level", F.lit(percentile / 100), F.col("_n")).alias("_cut")
    )
    return levels.join(cut, unit).where(F.col("level") > F.col("_cut")).drop("_cut")


def footprint_shape(mask: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pixel count, bounding box and centre of each unit's mask."""
    return mask.groupBy(*keys, "unit_id").agg(
        F.count("*").alias("pixels"),
        F.min("x").alias("min_x"),
        F.max("x").alias("max_x"),
        F.min("y").alias("min_y"),
        F.max("y").alias("max_y"),
        F.avg("x").alias("center_x"),
        F.avg("y").alias("center_y"),
    )


def frame_speed(
    frames: DataFrame,
    x="x",
    y="y",
    window: int = 10,
    keys: Sequence[str] = KEYS,
    chunk_frames: int = CHUNK_FRAMES,
) -> DataFrame:
    """Step length to the previous frame, and its centred mean over ``window`` frames.

    The mean needs ``window`` values, else it is NULL.
    """
    back, ahead = window // 2, (window - 1) // 2
    rows = frames.select(*keys, FRAME, x, y).transform(
        with_halo, keys, FRAME, before=back + 1, after=ahead, size=chunk_frames
    )
    over = chunk_window(keys, FRAME)
    dx, dy = (F.col(c) - F.lag(c).over(over) for c in (x, y))
    rows = rows.withColumn("speed", F.sqrt(dx * dx + dy * dy))
    span = over.rowsBetween(-back, ahead)
    full = F.count("speed").over(span) == window
    rows = rows.withColumn("smooth_speed", F.when(full, F.avg("speed").over(span)))
    return keep_home(rows)
