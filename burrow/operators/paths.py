"""Start-to-goal paths (transitions) and the aggregates inside them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from burrow.operators.chunks import (
    CHUNK,
    CHUNK_FRAMES,
    chunk_window,
    last_before,
    previous_row,
    with_chunk,
)

KEYS = ("session_id",)
FRAME = "frame_number"
DEFAULT_FPS = 30.0


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


def matches(column: str, value) -> Column:
    """Start/end test: numbers compare as numbers, everything else as text."""
    col = F.col(column)
    if isinstance(value, Column):
        return F.coalesce(value, F.lit(False))
    if isinstance(value, bool):
        return F.coalesce(col.cast("boolean") == F.lit(value), F.lit(False))
    if isinstance(value, (int, float)):
        return F.coalesce(col == F.lit(value), F.lit(False))
    if isinstance(value, tuple):
        u, v = value
        return F.coalesce((col["u"] == F.lit(u)) & (col["v"] == F.lit(v)), F.lit(False))
    return F.coalesce(col.cast("string") == F.lit(str(value)), F.lit(False))


def _mask(frames: DataFrame, column: str, value) -> Column:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if number and isinstance(frames.schema[column].dataType, StringType):
        return F.lit(False)  # text is never equal to a number
    return matches(column, value)


def transitions(
    frames: DataFrame,
    start_column: str,
    start_value,
    end_column: str,
    end_value,
    *,
    first_end: bool = True,
    min_length: int = 0,
    max_length: int | None = None,
    min_distinct: Mapping[str, int] | None = None,
    keys: Sequence[str] = KEYS,
    chunk_frames: int = CHUNK_FRAMES,
) -> DataFrame:
    """Non-overlapping start→end paths per session: keys, path_id, start_frame, end_frame.

    Matching is greedy: the first free start row, then the first end row after
    it (or, with ``first_end=False``, the last end row before the next start).
    Rows that are neither start nor end are dropped first. On the rest the
    greedy scan is a one-bit state machine in which every row sets, keeps or
    flips the bit; such steps compose, so they run per chunk and only one
    summary row per chunk crosses the chunk borders.
    """
    keys = list(keys)
    require_columns(frames, start_column, end_column, *keys, FRAME)
    events = (
        frames.select(
            *keys,
            FRAME,
            _mask(frames, start_column, start_value).alias("_s"),
            _mask(frames, end_column, end_value).alias("_e"),
        )
        .where("_s or _e")
        .transform(with_chunk, FRAME, chunk_frames)
    )
    if first_end:
        steps = _first_end_steps(events)
    else:
        steps = _last_end_steps(events, keys)
    found = _pair(_scan(steps, keys), keys)
    length = F.col("end_frame") - F.col("start_frame")
    if min_length > 0:
        found = found.where(length >= min_length)
    if max_length is not None:
        found = found.where(length <= max_length)
    for column, least in (min_distinct or {}).items():
        if column in frames.columns:
            counted = distinct_in_path(frames, found, column, keys=keys, chunk_frames=chunk_frames)
            found = counted.where(F.col("distinct_values") >= least).drop("distinct_values")
    return found


def _first_end_steps(events: DataFrame) -> DataFrame:
    # Bit = "a path is open". A row that is both start and end flips it.
    both = F.col("_s") & F.col("_e")
    return events.withColumns(
        {
            "_set": F.when(~both, F.col("_s").cast("int")),
            "_flip": both.cast("int"),
            "_start0": F.col("_s"),
            "_start1": F.lit(False),
            "_end0": F.lit(False),
            "_end1": F.col("_e"),
        }
    )


def _last_end_steps(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    # What the bit means depends on the previous event row:
    #   after a start-only row  0 = open, no end seen     1 = next end closes
    #   after an end-only row   0 = idle                  1 = open, end seen
    #   after a row of both     0 = idle                  1 = open, no end seen
    kind = F.when(F.col("_s") & F.col("_e"), "both").when(F.col("_s"), "start").otherwise("end")
    rows = previous_row(events.withColumn("_kind", kind), keys, FRAME, {"_kind": "_prev"})
    prev, kind = F.coalesce(F.col("_prev"), F.lit("end")), F.col("_kind")
    after_start, after_end, after_both = prev == "start", prev == "end", prev == "both"
    start, end, both = kind == "start", kind == "end", kind == "both"
    set_bit = (
        F.when(after_start & start, 1)
        .when(after_start & both, 0)
        .when(after_end & start, 0)
        .when(after_end & both, 1)
    )
    flip = (after_start & end) | (after_both & both)
    return rows.withColumns(
        {
            "_set": set_bit,
            "_flip": flip.cast("int"),
            # idle + start opens a path; so does a start that closes an open path with an end
            "_start0": ~after_start & ~end,
            "_start1": after_end & ~end,
            "_end0": after_start & ~start,
            "_end1": (after_start & ~start) | (after_end & end) | (after_both & ~start),
        }
    ).drop("_kind", "_prev")


def _scan(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Resolve the bit before every row and number the starts."""
    window = chunk_window(keys, FRAME)
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    flips = F.sum("_flip").over(upto)
    rows = steps.withColumn("_flips", flips)
    rows = rows.withColumns(
        {
            "_last": F.last("_set", ignorenulls=True).over(upto),
            "_at": F.last(F.when(F.col("_set").isNotNull(), F.col("_flips")), ignorenulls=True).over(upto),
        }
    )
    rows = rows.withColumn("_odd", (F.col("_flips") - F.coalesce("_at", F.lit(0))) % 2)
    rows = rows.withColumns(
        {"_last0": F.lag("_last").over(window), "_odd0": F.coalesce(F.lag("_odd").over(window), F.lit(0))}
    )

    def bit(carry: int) -> Column:
        return (F.coalesce("_last0", F.lit(carry)) + F.col("_odd0")) % 2

    def flag(name: str, carry: int) -> Column:
        return F.when(bit(carry) == 1, F.col(f"_{name}1")).otherwise(F.col(f"_{name}0"))

    rows = rows.withColumns(
        {f"_{n}_if{c}": flag(n, c) for n in ("start", "end") for c in (0, 1)}
    )
    rows = rows.withColumns(
        {f"_n_if{c}": F.sum(F.col(f"_start_if{c}").cast("long")).over(upto) for c in (0, 1)}
    )
    tail = F.max_by(F.struct("_last", "_odd", "_n_if0", "_n_if1"), FRAME).alias("_t")
    chunks = rows.groupBy(*keys, CHUNK).agg(tail).select(*keys, CHUNK, "_t.*")
    # The same composition once more, over one row per chunk.
    chunks = chunks.withColumns(
        {
            "_cset": (F.col("_last") + F.col("_odd")) % 2,
            "_cflip": F.when(F.col("_last").isNull(), F.col("_odd")).otherwise(F.lit(0)),
        }
    )
    over = Window.partitionBy(*keys).orderBy(CHUNK)
    inclusive = over.rowsBetween(Window.unboundedPreceding, 0)
    chunks = chunks.withColumn("_cflips", F.sum("_cflip").over(inclusive))
    chunks = chunks.withColumns(
        {
            "_cl": F.last("_cset", ignorenulls=True).over(inclusive),
            "_ca": F.last(F.when(F.col("_cset").isNotNull(), F.col("_cflips")), ignorenulls=True).over(inclusive),
        }
    )
    out = (F.coalesce("_cl", F.lit(0)) + F.col("_cflips") - F.coalesce("_ca", F.lit(0))) % 2
    chunks = chunks.withColumn("_out", out)
    chunks = chunks.withColumn("_carry", F.coalesce(F.lag("_out").over(over), F.lit(0)))
    opened = F.when(F.col("_carry") == 1, F.col("_n_if1")).otherwise(F.col("_n_if0"))
    chunks = chunks.withColumn("_opened", opened)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(
        *keys, CHUNK, "_carry", F.coalesce(F.sum("_opened").over(before), F.lit(0)).alias("_base")
    )
    carried = F.col("_carry") == 1

    def pick(name: str) -> Column:
        return F.when(carried, F.col(f"_{name}_if1")).otherwise(F.col(f"_{name}_if0"))

    return rows.join(chunks, [*keys, CHUNK]).select(
        *keys,
        FRAME,
        pick("start").alias("_start"),
        pick("end").alias("_end"),
        (F.col("_base") + pick("n") - 1).alias("path_id"),
    )


def _pair(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    # No row is both a start and an end here: a start that cuts off an open path
    # leaves that path with the end it has already seen.
    frame = F.col(FRAME)
    return (
        rows.where("_start or _end")
        .groupBy(*keys, "path_id")
        .agg(
            F.min(F.when(F.col("_start"), frame)).alias("start_frame"),
            F.max(F.when(F.col("_end"), frame)).alias("end_frame"),
        )
        .where("end_frame is not null")
    )


def in_paths(
    frames: DataFrame,
    paths: DataFrame,
    columns: Sequence[str] = (),
    *,
    previous: Sequence[str] = (),
    keys: Sequence[str] = KEYS,
    chunk_frames: int = CHUNK_FRAMES,
) -> DataFrame:
    """Frames that lie in a path, with path_id, start_frame and end_frame.

    A path leaves one marker row at its start and one at the head of every
    further chunk it covers. The last marker seen decides the path of a frame,
    so no frame × path pairs are formed. The result stays chunked. Columns in
    ``previous`` also come as ``_prev_{name}``, taken from the row before.
    """
    keys = list(keys)
    size = F.lit(chunk_frames)
    rows = frames.select(*keys, FRAME, *columns).transform(with_chunk, FRAME, chunk_frames)
    tails = last_before(rows, keys, FRAME, previous) if previous else None
    rows = rows.withColumn("_is_row", F.lit(1))
    path = F.struct("path_id", "start_frame", "end_frame")
    marks = paths.select(
        *keys,
        path.alias("_path"),
        F.explode(
            F.sequence(F.floor(F.col("start_frame") / size), F.floor(F.col("end_frame") / size))
        ).alias(CHUNK),
    ).withColumns(
        {
            FRAME: F.greatest(F.col("_path.start_frame"), F.col(CHUNK) * size),
            "_is_row": F.lit(0),
        }
    )
    both = rows.unionByName(marks, allowMissingColumns=True)
    window = Window.partitionBy(*keys, CHUNK).orderBy(FRAME, "_is_row")
    seen = F.last("_path", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    lagged = {}
    if previous:
        row = F.when(F.col("_is_row") == 1, F.struct(*previous))
        before = window.rowsBetween(Window.unboundedPreceding, -1)
        lagged["_prev"] = F.last(row, ignorenulls=True).over(before)
    inside = both.withColumns({"_path": seen, **lagged}).where(
        (F.col("_is_row") == 1) & (F.col(FRAME) <= F.col("_path.end_frame"))
    )
    if previous:
        # The first row of a chunk follows the last row of an earlier one.
        inside = inside.join(tails, [*keys, CHUNK]).withColumn("_prev", F.coalesce("_prev", "_tail"))
    return (
        inside
        .select(
            *keys,
            CHUNK,
            FRAME,
            *columns,
            *[F.col(f"_prev.{c}").alias(f"_prev_{c}") for c in previous],
            "_path.*",
        )
    )


def distinct_in_path(frames, paths, column, *, keys=KEYS, chunk_frames=CHUNK_FRAMES) -> DataFrame:
    """Number of distinct non-null values of ``column`` in each path."""
    rows = in_paths(frames, paths, [column], keys=keys, chunk_frames=chunk_frames)
    # First to distinct values, so that the path itself is never one big group.
    values = rows.groupBy(*keys, "path_id", "start_frame", "end_frame", column).agg(F.lit(1).alias("_one"))
    return values.groupBy(*keys, "path_id", "start_frame", "end_frame").agg(
        F.count(column).alias("distinct_values")
    )


def _collapsed(frames, paths, column, keys, chunk_frames) -> DataFrame:
    """Rows with a value, and whether it differs from the one before in the path."""
    window = chunk_window(keys, FRAME)
    rows = in_paths(frames, paths, [column], keys=keys, chunk_frames=chunk_frames)
    rows = rows.where(F.col(column).isNotNull())
    rows = rows.withColumns(
        {"_pv": F.lag(column).over(window), "_pp": F.lag("path_id").over(window)}
    )
    head = F.coalesce(F.col("_pp") != F.col("path_id"), F.lit(True))
    return rows.withColumns(
        {"_head": head, "_new": ~head & (F.col("_pv") != F.col(column))}
    ).drop("_pv", "_pp")


def _path_chunks(rows: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """One row per path and chunk: inner changes, and whether its head is a change."""
    pieces = rows.groupBy(*keys, "path_id", CHUNK).agg(
        F.count_if("_new").alias("_inner"),
        F.count("*").alias("_rows"),
        F.min_by(column, FRAME).alias("_first"),
        F.max_by(column, FRAME).alias("_last"),
    )
    window = Window.partitionBy(*keys, "path_id").orderBy(CHUNK)
    tail = F.lag("_last").over(window)
    return pieces.withColumns(
        {"_opens": tail.isNull(), "_turn": F.coalesce(tail != F.col("_first"), F.lit(False))}
    )


def changes_in_path(frames, paths, column, *, keys=KEYS, chunk_frames=CHUNK_FRAMES) -> DataFrame:
    """Value changes in each path, missing values skipped."""
    keys = list(keys)
    rows = _collapsed(frames, paths, column, keys, chunk_frames)
    pieces = _path_chunks(rows, column, keys)
    counted = pieces.groupBy(*keys, "path_id").agg(
        F.sum(F.col("_inner") + F.col("_turn").cast("long")).alias("value_changes")
    )
    return paths.join(counted, [*keys, "path_id"], "left").withColumn(
        "value_changes", F.coalesce("value_changes", F.lit(0).cast("long"))
    )


def sequence_in_path(
    frames, paths, column, *, collapse: bool = True, keys=KEYS, chunk_frames=CHUNK_FRAMES
) -> DataFrame:
    """Ordered non-null values of each path: keys, path_id, pos, frame_number, value.

    One row per element instead of one list per path, so that a path of any
    length stays spread over tasks. ``collapse`` drops repeats of a run.
    """
    keys = list(keys)
    rows = _collapsed(frames, paths, column, keys, chunk_frames)
    pieces = _path_chunks(rows, column, keys)
    if collapse:
        kept = F.col("_inner") + (F.col("_opens") | F.col("_turn")).cast("long")
    else:
        kept = F.col("_rows")
    window = Window.partitionBy(*keys, "path_id").orderBy(CHUNK)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    bases = pieces.select(
        *keys,
        "path_id",
        CHUNK,
        (F.col("_opens") | F.col("_turn")).alias("_head_kept"),
        F.coalesce(F.sum(kept).over(before), F.lit(0)).alias("_base"),
    )
    joined = rows.join(bases, [*keys, "path_id", CHUNK])
    if collapse:
        joined = joined.where(F.col("_new") | (F.col("_head") & F.col("_head_kept")))
    local = Window.partitionBy(*keys, CHUNK, "path_id").orderBy(FRAME)
    return joined.select(
        *keys,
        "path_id",
        (F.row_number().over(local) - 1 + F.col("_base")).alias("pos"),
        FRAME,
        F.col(column).alias("value"),
    )


def distance_in_path(
    frames,
    paths,
    x_column="x",
    y_column="y",
    *,
    pixel_to_meter=None,
    keys=KEYS,
    chunk_frames=CHUNK_FRAMES,
) -> DataFrame:
    """Sum of Euclidean steps between adjacent frames; steps with a gap are skipped."""
    keys = list(keys)
    at = [x_column, y_column]
    rows = in_paths(frames, paths, at, previous=at, keys=keys, chunk_frames=chunk_frames)
    dx, dy = (F.col(c) - F.col(f"_prev_{c}") for c in at)
    inner = F.when(F.col(FRAME) > F.col("start_frame"), F.sqrt(dx * dx + dy * dy))
    out = rows.groupBy(*keys, "path_id", "start_frame", "end_frame").agg(
        F.coalesce(F.sum(inner), F.lit(0.0)).alias("distance")
    )
    if pixel_to_meter is not None:
        scale = pixel_to_meter if isinstance(pixel_to_meter, Column) else F.lit(float(pixel_to_meter))
        out = out.withColumn("distance", F.col("distance") * scale)
    return out


def time_in_path(paths, sessions=None, *, keys=KEYS) -> DataFrame:
    """Seconds from start to end; ``sessions`` supplies fps, else 30."""
    frames = F.col("end_frame") - F.col("start_frame")
    if sessions is None:
        return paths.withColumn("seconds", frames / F.lit(DEFAULT_FPS))
    fps = sessions.select(*keys, F.col("fps").alias("_fps"))
    return (
        paths.join(fps, list(keys), "left")
        .withColumn("seconds", F.try_divide(frames, F.coalesce("_fps", F.lit(DEFAULT_FPS))))
        .drop("_fps")
    )


def velocity_in_path(
    frames,
    paths,
    x_column="x",
    y_column="y",
    *,
    sessions=None,
    pixel_to_meter: float | None = None,
    keys=KEYS,
    chunk_frames=CHUNK_FRAMES,
) -> DataFrame:
    """Distance over time per path.

    The scale is the argument if given, else the session's pixel_to_meter,
    else one unit per pixel.
    """
    keys = list(keys)
    moved = distance_in_path(
        frames, paths, x_column, y_column, keys=keys, chunk_frames=chunk_frames
    )
    timed = time_in_path(moved, sessions, keys=keys)
    if pixel_to_meter is not None:
        scale = F.lit(float(pixel_to_meter))
    elif sessions is not None and "pixel_to_meter" in sessions.columns:
        meta = sessions.select(*keys, F.col("pixel_to_meter").alias("_scale"))
        timed = timed.join(meta, keys, "left")
        scale = F.coalesce("_scale", F.lit(1.0))
    else:
        scale = F.lit(1.0)
    moving = F.col("seconds") > 0
    return timed.withColumn("distance", F.col("distance") * scale).withColumn(
        "velocity", F.when(moving, F.try_divide("distance", "seconds")).otherwise(F.lit(0.0))
    ).drop("_scale")


def graph_side(column: str) -> str | None:
    """Whether a column name speaks of a graph's nodes or edges."""
    name = column.lower()
    return "nodes" if "node" in name else "edges" if "edge" in name else None


def values_in_path(
    frames,
    paths,
    column: str,
    mode: str = "unique",
    *,
    total: int | None = None,
    graph_totals: tuple[int, int] | DataFrame | None = None,
    keys=KEYS,
    chunk_frames=CHUNK_FRAMES,
) -> DataFrame:
    """Per path: distinct values, value changes, or share of a total in percent.

    Without ``total`` the share is taken of the graph's node or edge count
    (``graph_totals``, one pair for all or rows of (keys, nodes, edges) with
    each session's own), picked by the column name; failing that, of the distinct
    count of the session's first path, so later paths can exceed 100.
    An unknown mode yields no rows.
    """
    keys = list(keys)
    args = {"keys": keys, "chunk_frames": chunk_frames}
    if mode == "unique":
        return distinct_in_path(frames, paths, column, **args).withColumn(
            "value", F.col("distinct_values").cast("double")
        ).drop("distinct_values")
    if mode == "transitions":
        return changes_in_path(frames, paths, column, **args).withColumn(
            "value", F.col("value_changes").cast("double")
        ).drop("value_changes")
    counted = distinct_in_path(frames, paths, column, **args)
    if mode != "percentage":
        return counted.where(F.lit(False)).withColumn(
            "value", F.col("distinct_values").cast("double")
        ).drop("distinct_values")
    side = graph_side(column) if total is None and graph_totals is not None else None
    if side and not isinstance(graph_totals, DataFrame):
        total = graph_totals[("nodes", "edges").index(side)]
    if total is not None:
        counted = counted.withColumn("_total", F.lit(total).cast("double"))
    elif side:
        own = graph_totals.select(*keys, F.col(side).cast("double").alias("_total"))
        counted = counted.join(own, keys, "left")
    else:
        first = counted.groupBy(*keys).agg(
            F.min_by("distinct_values", "start_frame").cast("double").alias("_total")
        )
        counted = counted.join(first, keys)
    share = F.when(F.col("_total") > 0, F.col("distinct_values") / F.col("_total") * 100)
    return counted.withColumn("value", F.coalesce(share, F.lit(0.0))).drop(
        "distinct_values", "_total"
    )
