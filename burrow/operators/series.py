"""Ordered series inside a session: unwrapping, smoothing, trails, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burrow.operators.chunks import (
    CHUNK,
    CHUNK_FRAMES,
    chunk_window,
    keep_home,
    running_sum,
    with_halo,
)

KEYS = ("session_id",)
TRAIL = 100
TRACE_WINDOW = 150
ACTIVE = 0.05
MOST_UNITS = 50


def unwrap(
    df: DataFrame, angle: str, order: str, name="unwrapped", keys: Sequence[str] = KEYS, chunk_frames=CHUNK_FRAMES
) -> DataFrame:
    """Remove jumps of half a turn or more by adding whole turns."""
    over = chunk_window(keys, order)
    rows = df.transform(with_halo, keys, order, before=1, size=chunk_frames)
    step = F.col(angle) - F.lag(angle).over(over)
    rows = keep_home(rows.withColumn("_d", step), drop_chunk=False)
    short = F.pmod(F.col("_d") + 180.0, F.lit(360.0)) - 180.0
    short = F.when((short == -180.0) & (F.col("_d") > 0), F.lit(180.0)).otherwise(short)
    turn = F.when(F.abs("_d") >= 180.0, short - F.col("_d")).otherwise(F.lit(0.0))
    rows = rows.withColumn("_turn", turn)
    return (
        running_sum(rows, keys, order, "_turn", "_turns")
        .withColumn(name, F.col(angle) + F.col("_turns"))
        .drop("_d", "_turn", "_turns", CHUNK)
    )


def gradient(
    df: DataFrame,
    value: str,
    order: str,
    name="velocity",
    dt: float = 1.0,
    position: str | None = None,
    keys: Sequence[str] = KEYS,
    chunk_frames=CHUNK_FRAMES,
) -> DataFrame:
    """Central difference inside, one-sided at both ends.

    ``dt`` divides an evenly spaced series; ``position`` names a column of
    sample positions for an uneven one.
    """
    over = chunk_window(keys, order)
    rows = df.transform(with_halo, keys, order, before=1, after=1, size=chunk_frames)
    here, back, ahead = F.col(value), F.lag(value).over(over), F.lead(value).over(over)
    at = F.col(position) if position else F.col(order).cast("double") * dt
    first, last = F.lag(order).over(over).isNull(), F.lead(order).over(over).isNull()
    hs = at - F.lag(at).over(over)
    hd = F.lead(at).over(over) - at
    if position:
        inner = F.try_divide(
            hs * hs * ahead + (hd * hd - hs * hs) * here - hd * hd * back, hs * hd * (hs + hd)
        )
    else:
        inner = (ahead - back) / (2 * dt)
    left = F.try_divide(here - back, hs if position else F.lit(dt))
    right = F.try_divide(ahead - here, hd if position else F.lit(dt))
    return keep_home(rows.withColumn(name, F.when(first, right).when(last, left).otherwise(inner)))


def smooth(
    df: DataFrame, value: str, order: str, size: int, name="smoothed", keys: Sequence[str] = KEYS, chunk_frames=CHUNK_FRAMES
) -> DataFrame:
    """Moving sum of ``size`` samples over ``size``; beyond the ends counts as zero."""
    back, ahead = size // 2, (size - 1) // 2
    rows = df.transform(with_halo, keys, order, before=back, after=ahead, size=chunk_frames)
    over = chunk_window(keys, order).rowsBetween(-back, ahead)
    return keep_home(rows.withColumn(name, F.sum(value).over(over) / F.lit(size)))


def angular_velocity(
    df: DataFrame,
    angle: str,
    order: str,
    dt: float = 1.0,
    position: str | None = None,
    smooth_window: int = 1,
    keys: Sequence[str] = KEYS,
    chunk_frames=CHUNK_FRAMES,
) -> DataFrame:
    args = {"keys": keys, "chunk_frames": chunk_frames}
    rows = unwrap(df, angle, order, **args)
    rows = gradient(rows, "unwrapped", order, "velocity", dt, position, **args)
    if smooth_window > 1:
        rows = smooth(rows, "velocity", order, smooth_window, "_smooth", **args)
        rows = rows.withColumn("velocity", F.col("_smooth")).drop("_smooth")
    return rows


def trail(
    points: DataFrame, length: int = TRAIL, keys: Sequence[str] = ("session_id", "bodypart"), order="frame_number", chunk_frames=CHUNK_FRAMES
) -> DataFrame:
    """The last ``length`` points up to each row, oldest first, with recency weights.

    The trail counts points, not frames.
    """
    rows = points.transform(with_halo, keys, order, before=length - 1, size=chunk_frames)
    over = chunk_window(keys, order).rowsBetween(-(length - 1), 0)
    rows = keep_home(rows.withColumn("_points", F.collect_list(F.struct("x", "y")).over(over)))
    size = F.size("_points")
    weighted = F.transform(
        "_points", lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), ((i + 1) / size).alias("weight"))
    )
    return rows.withColumn("trail", weighted).drop("_points")


def trace_window(
    df: DataFrame,
    value: str,
    order: str,
    size: int = TRACE_WINDOW,
    margin: float = 0.1,
    fixed: tuple[float, float] | None = None,
    continuous: bool = False,
    keys: Sequence[str] = KEYS,
    chunk_frames=CHUNK_FRAMES,
) -> DataFrame:
    """Current value, vertical range and left edge of the last ``size`` samples."""
    rows = df.transform(with_halo, keys, order, before=size - 1, size=chunk_frames)
    over = chunk_window(keys, order).rowsBetween(-(size - 1), 0)
    low, high = F.min(value).over(over), F.max(value).over(over)
    rows = keep_home(rows.withColumns({"_low": low, "_high": high}))
    low, high = F.col("_low"), F.col("_high")
    if fixed is None:
        pad = F.when(low != high, (high - low) * margin).otherwise(F.lit(1.0))
        ranges = {"y_low": low - pad, "y_high": high + pad}
    else:
        ranges = {"y_low": F.lit(float(fixed[0])), "y_high": F.lit(float(fixed[1]))}
    offset = F.greatest(F.col(order) + 1 - size, F.lit(0)) if continuous else F.lit(0)
    return rows.withColumns(ranges | {"current": F.col(value), "x_offset": offset.cast("bigint")}).drop("_low", "_high")


def active_units(df: DataFrame, threshold: float = ACTIVE, activity="activity", contour="contour") -> DataFrame:
    """Units above the threshold that have a contour."""
    return df.where((F.col(activity) > threshold) & (F.size(contour) > 0))


def top_units(df: DataFrame, k: int = MOST_UNITS, activity="activity", keys: Sequence[str] = ("session_id", "frame_number")) -> DataFrame:
    """The ``k`` most active units of each frame, ties in unit order.

    A ranking with a bound is cut to k rows per task before the shuffle.
    """
    over = Window.partitionBy(*keys).orderBy(F.desc(activity), "unit_id")
    return df.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)


def normalised_activity(df: DataFrame, activity="activity", keys: Sequence[str] = ("session_id", "frame_number")) -> DataFrame:
    """Activity scaled to 0..1 inside each frame; 1 where all are equal.

    Meant for the output of top_units, which bounds the rows of a frame.
    """
    over = Window.partitionBy(*keys)
    low, high = F.min(activity).over(over), F.max(activity).over(over)
    scaled = F.when(high > low, (F.col(activity) - low) / (high - low)).otherwise(F.lit(1.0))
    return df.withColumn("normalised", scaled)
