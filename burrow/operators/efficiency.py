"""How closely paths follow an optimal route.

The score of a path is a fold over its visited values with a small state: how
far along the route it is, and how many strikes it has just used. A path may be
long, so it is cut into pieces of bounded length. Each piece is folded once per
state it could be entered in, which turns it into a table from entry state to
exit state and counts; the tables of a path are then put together in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burrow.operators import paths as P
from burrow.operators.chunks import CHUNK_FRAMES

PIECE = 4096


def route_scores(
    frames: DataFrame,
    paths: DataFrame,
    column: str,
    route: Sequence | DataFrame,
    *,
    strike_levels: Sequence | None = None,
    max_strikes: int = 0,
    keys: Sequence[str] = P.KEYS,
    chunk_frames: int = CHUNK_FRAMES,
    piece: int = PIECE,
) -> DataFrame:
    """Per path: progress, deviations, strikes_used, completed, lengths and efficiency.

    The first value of a path is compared with the second of the route, so a
    perfect path that includes its start has one deviation. ``strike_levels``
    only switches strikes on. The route is a list for all paths, or rows of
    (keys, pos, node) with a route for each key; keys that have none (or only a
    row with a null pos) get paths without progress. Values are compared with
    nodes as text, the form node ids have.
    """
    keys = list(keys)
    per_path = [*keys, "path_id"]
    strikes = max_strikes if strike_levels and max_strikes > 0 else 0
    seen = P.sequence_in_path(frames, paths, column, keys=keys, chunk_frames=chunk_frames)
    if isinstance(route, DataFrame):
        # A route is short: one map per key, joined once. A node's first place wins.
        nodes = route.groupBy(*keys, F.col("node").cast("string").alias("_node")).agg(F.min("pos").alias("_spot"), F.max("pos").alias("_top"))
        entry = F.when(F.col("_spot").isNotNull() & F.col("_node").isNotNull(), F.struct("_node", F.col("_spot").cast("int")))
        routes = nodes.groupBy(*keys).agg(
            F.map_from_entries(F.collect_list(entry)).alias("_route"), F.coalesce(F.max("_top").cast("int"), F.lit(-1)).alias("_last")
        )
        seen = seen.join(routes, keys, "left").withColumn("_last", F.coalesce("_last", F.lit(-1)))
        paths = paths.join(routes.drop("_route"), keys, "left").withColumn("_last", F.coalesce("_last", F.lit(-1)))
        spot = F.coalesce(F.try_element_at("_route", F.col("value").cast("string")), F.lit(-1))
    else:
        spot = F.lit(-1)
        # Read backwards, so that a value's first place on the route wins.
        for i in range(len(route) - 1, -1, -1):
            spot = F.when(F.col("value").cast("string") == F.lit(str(route[i])), F.lit(i)).otherwise(spot)
        seen, paths = (df.withColumn("_last", F.lit(len(route) - 1)) for df in (seen, paths))
    last = F.col("_last")
    size = F.lit(piece)
    pieces = (
        seen.select(*per_path, "pos", spot.alias("spot"), "_last", F.floor(F.col("pos") / size).alias("_piece"))
        .groupBy(*per_path, "_piece", "_last")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "spot"))), lambda r: r["spot"]).alias("_spots"),
            F.count("*").alias("_n"),
        )
    )
    places = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    states = F.flatten(F.transform(places, lambda p: F.array(*[_state(p, s) for s in range(strikes + 1)])))
    entry = F.when(F.col("_piece") == 0, F.array(_state(0, 0))).otherwise(states)
    folded = F.aggregate(
        "_spots", entry, lambda acc, spot: F.transform(acc, lambda st: _visit(st, spot, last, strikes))
    )
    tables = pieces.select(*per_path, "_piece", "_last", folded.alias("_table"), "_n")
    # Pieces of a path, then groups of pieces: every list stays short.
    tables = tables.withColumn("_group", F.floor(F.col("_piece") / size))
    groups = _chained(tables, [*per_path, "_last", "_group"], "_piece", F.col("_group") == 0, states, strikes)
    whole = _chained(groups, [*per_path, "_last"], "_group", F.lit(True), states, strikes)
    out = paths.join(whole.drop("_last"), per_path, "left")
    end = F.col("_table")[0]
    zero = F.lit(0).cast("bigint")
    visited = F.coalesce("_n", zero)
    actual = F.greatest(visited - 1, zero)
    optimal = F.greatest(last, F.lit(0))
    progress = F.coalesce(end["progress"], F.lit(0))
    return out.select(
        *keys,
        "path_id",
        progress.alias("progress"),
        F.coalesce(end["deviations"], zero).alias("deviations"),
        F.coalesce(end["used"], zero).alias("strikes_used"),
        (progress == last).alias("completed"),
        optimal.alias("optimal_length"),
        actual.alias("actual_length"),
        F.when(actual > 0, optimal / actual * 100).otherwise(F.lit(0.0)).alias("efficiency"),
    )


def _state(progress: int | Column, strikes: int) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.struct(
        (progress if isinstance(progress, Column) else F.lit(progress)).alias("progress"),
        F.lit(strikes).alias("strikes"),
        zero.alias("deviations"),
        zero.alias("used"),
    )


def _visit(st: Column, spot: Column, last: Column, strikes: int) -> Column:
    """State after one more visited value; ``spot`` is its place on the route or -1."""
    progress, run = st["progress"], st["strikes"]
    under_way = progress < last
    on_route = spot == progress + 1
    off = under_way & ~on_route
    free = off & (run < strikes)
    reset = off & ~free if strikes else F.lit(False)
    return F.struct(
        F.when(under_way & on_route, progress + 1)
        .when(reset & (spot >= 0), spot)
        .otherwise(progress)
        .alias("progress"),
        F.when(free, run + 1).when((under_way & on_route) | reset, F.lit(0)).otherwise(run).alias("strikes"),
        (st["deviations"] + off.cast("bigint")).alias("deviations"),
        (st["used"] + free.cast("bigint")).alias("used"),
    )


def _chained(tables: DataFrame, by: Sequence[str], order: str, from_start: Column, states: Column, strikes: int) -> DataFrame:
    """Run through the tables of a group in order, from every state it may be entered in."""
    listed = tables.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("_table").alias("table")))).alias("_list"),
        F.sum("_n").alias("_n"),
    )
    entry = F.when(from_start, F.array(_state(0, 0))).otherwise(states)

    def follow(st: Column, table: Column) -> Column:
        exit_ = table[st["progress"] * (strikes + 1) + st["strikes"]]
        return F.struct(
            exit_["progress"].alias("progress"),
            exit_["strikes"].alias("strikes"),
            (st["deviations"] + exit_["deviations"]).alias("deviations"),
            (st["used"] + exit_["used"]).alias("used"),
        )

    run = F.aggregate("_list", entry, lambda acc, t: F.transform(acc, lambda st: follow(st, t["table"])))
    return listed.select(*by, run.alias("_table"), "_n")
