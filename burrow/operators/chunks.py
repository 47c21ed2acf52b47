"""Ordered computation inside a session without one task per session.

A session may hold a large share of all rows, so no window here is partitioned
by session alone over the facts. The frame axis is cut into chunks of a fixed
number of frames; windows run per (session, chunk), and what has to cross a
chunk border travels through a summary with one row per chunk, or through a
halo of copied border rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burrow.operators.skew import TARGET_ROWS, hot_keys, key_counts
from burrow.session import materialise

CHUNK_FRAMES = 1 << 17
CHUNK = "_chunk"
#: Rows that a task sorts to number them, on average at most.
TASK_ROWS = 2_000_000


def with_chunk(df: DataFrame, order: str, size: int = CHUNK_FRAMES) -> DataFrame:
    return df.withColumn(CHUNK, F.floor(F.col(order) / F.lit(size)))


def chunk_window(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys, CHUNK).orderBy(order)


def same_keys(keys: Sequence[str], left: str = "a", right: str = "b") -> Column:
    tests = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    return reduce(lambda x, y: x & y, tests)


def with_ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "frame_number", target: int = TARGET_ROWS
) -> DataFrame:
    """Dense 0-based position of each row inside its key, in ``order``.

    For sources that carry no frame number. Rows are dealt by key and shuffled
    once, to enough tasks for ``TASK_ROWS`` each, whatever the input's size; only
    keys with more than ``target`` rows, found by a count per key, are spread over
    tasks. ``order`` must identify a row within its key.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    if not keys:
        return _spread_ordinal(df, keys, order, name)
    counted = key_counts(df, keys)
    hot, _ = hot_keys(df, keys, target, counted=counted)
    rows = df
    if hot is not None:
        is_hot = same_keys(keys)
        rows = df.alias("a").join(F.broadcast(hot).alias("b"), is_hot, "left_anti")
    # A given number of parts: they become the files later scans are split by.
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(usual, -(-counted[1] // TASK_ROWS))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    out = rows.repartition(parts, *keys).withColumn(name, place.cast("bigint"))
    if hot is None:
        return out
    spread = df.alias("a").join(F.broadcast(hot).alias("b"), is_hot, "left_semi")
    return out.unionByName(_spread_ordinal(spread, keys, order, name, parts))


def _spread_ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, ranges: int | None = None
) -> DataFrame:
    """The same for keys of any size, few enough to list.

    Rows are range-partitioned on (keys, order), so a hot key is spread over many
    partitions; the sorted rows are written once, and the offset of each
    partition comes from a count per (key, partition).
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        df.repartitionByRange(ranges, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    stored = materialise(ordered, "ordered")
    runs = stored.groupBy(*keys, "_part").agg(
        F.min("_seq").alias("_first"), F.count("*").alias("_n")
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    found = stored.alias("a").join(F.broadcast(bases).alias("b"), same_keys([*keys, "_part"]))
    place = F.col("_seq") - F.col("_first") + F.col("_base")
    return found.select(*[F.col(f"a.`{c}`") for c in df.columns], place.alias(name))


def with_halo(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    before: int = 0,
    after: int = 0,
    size: int = CHUNK_FRAMES,
) -> DataFrame:
    """Copy border rows into the chunks that need them; ``_home`` marks originals.

    A halo of n is n rows however large the gaps in ``order`` are: windows up to
    ``before`` rows back and ``after`` rows ahead are exact per chunk. Rows stay
    where they are; only the last ``before`` and first ``after`` rows of each
    chunk are picked out, by a top-n that is bounded before its shuffle, and go
    to the chunks that they are near enough to by the chunks' numbers of rows.
    """
    home = with_chunk(df, order, size)
    sizes = home.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    out = home.withColumn("_home", F.lit(True))
    for reach, towards in ((before, 1), (after, -1)):
        if reach:
            out = out.unionByName(_borders(home, sizes, keys, order, reach, towards))
    return out


def _borders(home: DataFrame, sizes: DataFrame, keys: Sequence[str], order: str, reach: int, towards: int) -> DataFrame:
    """Copies of the rows that chunks ahead (1) or behind (-1) reach back to."""
    first = Window.partitionBy(*keys, CHUNK).orderBy(F.col(order) * -towards)
    edge = home.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= reach)
    # Every chunk but an empty one has a row, so ``reach`` chunks are enough. A
    # chunk that the others part by r rows needs all but the last r of the reach.
    ahead = Window.partitionBy(*keys).orderBy(F.col(CHUNK) * towards)
    passed = F.sum("_n").over(ahead.rowsBetween(Window.unboundedPreceding, 0))
    counted = sizes.withColumn("_passed", passed)
    others = F.collect_list(F.struct(F.col(CHUNK).alias("chunk"), (F.col("_passed") - F.col("_n")).alias("before")))
    targets = counted.withColumn("_to", others.over(ahead.rowsBetween(1, reach)))
    near = F.filter("_to", lambda t: t["before"] - F.col("_passed") < reach)
    targets = targets.select(*keys, CHUNK, "_passed", near.alias("_to")).where(F.size("_to") > 0)
    copies = edge.join(targets, [*keys, CHUNK]).select("*", F.explode("_to").alias("_at"))
    copies = copies.where(F.col("_at.before") - F.col("_passed") + F.col("_rank") <= reach)
    columns = [F.col("_at.chunk").alias(CHUNK) if c == CHUNK else F.col(c) for c in home.columns]
    return copies.select(*columns, F.lit(False).alias("_home"))


def keep_home(df: DataFrame, drop_chunk: bool = True) -> DataFrame:
    """Drop the halo. Keeping the chunk keeps the partitioning for a next window."""
    kept = df.where("_home").drop("_home")
    return kept.drop(CHUNK) if drop_chunk else kept


def previous_row(
    df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, str]
) -> DataFrame:
    """``lag`` of the given columns over a chunked frame with gaps in ``order``.

    ``columns`` maps a source column to the name of its lagged copy. The last
    row of each chunk is carried to the first row of the next one.
    """
    window = chunk_window(keys, order)
    sources = list(columns)
    local = df.withColumns(
        {columns[c]: F.lag(c).over(window) for c in sources}
        | {"_head": F.row_number().over(window) == 1}
    )
    joined = local.join(last_before(df, keys, order, sources, "_p_"), [*keys, CHUNK])
    return joined.withColumns(
        {
            columns[c]: F.when(F.col("_head"), F.col(f"_tail._p_{c}")).otherwise(F.col(columns[c]))
            for c in sources
        }
    ).drop("_head", "_tail")


def last_before(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], prefix: str = ""
) -> DataFrame:
    """One row per chunk with ``_tail``: the columns of the last row before it."""
    last = F.max_by(F.struct(*[F.col(c).alias(f"{prefix}{c}") for c in columns]), order)
    tails = df.groupBy(*keys, CHUNK).agg(last.alias("_tail"))
    ahead = Window.partitionBy(*keys).orderBy(CHUNK)
    return tails.withColumn("_tail", F.lag("_tail").over(ahead))


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: str, name: str
) -> DataFrame:
    """Inclusive running sum over a chunked frame; NULL counts as nothing."""
    window = chunk_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(*keys, CHUNK).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, CHUNK, F.sum("_total").over(before).alias("_carry"))
    local = df.withColumn(name, F.sum(value).over(window))
    zero = F.lit(0)
    return (
        local.join(totals, [*keys, CHUNK])
        .withColumn(name, F.coalesce(F.col(name), zero) + F.coalesce(F.col("_carry"), zero))
        .drop("_carry")
    )
