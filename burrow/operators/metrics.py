"""Session metrics, metric batteries and progressions over sessions."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burrow.operators import graph as GR
from burrow.operators import paths as P
from burrow.operators.chunks import with_ordinal
from burrow.operators.efficiency import route_scores
from burrow.session import materialise

KEYS = ("session_id",)
METRIC_SCHEMA = ("session_id", "metric", "path_id", "value")


def natural_key(column: str | Column) -> Column:
    """Sort key in which session_2 comes before session_10."""
    text = F.lower(F.col(column) if isinstance(column, str) else column)
    pieces = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(
        pieces,
        lambda t: F.when(t.rlike(r"^\d"), F.lpad(F.regexp_replace(t, r"^0+(?=\d)", ""), 20, "0")).otherwise(t),
    )


def exploration(
    frames: DataFrame,
    column: str,
    total: int | None = None,
    graph_totals: tuple[int, int] | DataFrame | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Distinct values visited over all there are, in percent.

    Without a total the graph's node or edge count is used, picked by the
    column name; with neither, the plain count comes back. ``graph_totals`` is
    one pair for all, or rows of (keys, nodes, edges) with each session's own.
    """
    keys = list(keys)
    if column not in frames.columns:
        return frames.groupBy(*keys).agg(F.lit(0.0).alias("exploration"))
    values = frames.groupBy(*keys, column).agg(F.lit(1).alias("_one"))
    counted = values.groupBy(*keys).agg(F.count(column).alias("_n"))
    side = P.graph_side(column) if total is None and graph_totals is not None else None
    if side and isinstance(graph_totals, DataFrame):
        counted = counted.join(graph_totals.select(*keys, F.col(side).alias("_total")), keys, "left")
        known = F.col("_total").isNotNull()
        share = F.when(~known, F.col("_n").cast("double")).otherwise(
            F.coalesce(F.try_divide(F.col("_n"), F.col("_total")) * 100, F.lit(0.0))
        )
        return counted.withColumn("exploration", share).drop("_n", "_total")
    if side:
        total = graph_totals[("nodes", "edges").index(side)]
    if total is None:
        share = F.col("_n").cast("double")
    elif total == 0:
        share = F.lit(0.0)
    else:
        share = F.col("_n") / F.lit(total) * 100
    return counted.withColumn("exploration", share).drop("_n")


def frame_count(frames: DataFrame, sessions: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Frames per session; listed sessions without frames count 0."""
    counted = frames.groupBy(*keys).agg(F.count("*").alias("num_frames"))
    if sessions is None:
        return counted
    return sessions.select(*keys).join(counted, list(keys), "left").withColumn(
        "num_frames", F.coalesce("num_frames", F.lit(0).cast("bigint"))
    )


# -- user metrics ------------------------------------------------------------

SESSION_METRICS: dict[str, Callable[..., DataFrame]] = {}
CROSS_METRICS: dict[str, Callable[..., DataFrame]] = {}


def session_metric(name: str):
    """Register ``f(frames, context, **args) -> (session_id, path_id, value)``."""

    def add(fn):
        SESSION_METRICS[name] = fn
        return fn

    return add


def cross_session_metric(name: str):
    """Register ``f(metrics, **args) -> DataFrame``."""

    def add(fn):
        CROSS_METRICS[name] = fn
        return fn

    return add


class Context:
    """What a metric may need besides frames: sessions, graphs, shared paths.

    ``edges`` may hold several graphs; ``graphs`` (session_id, graph_id) then
    tells which one a session has. Counts and routes come from that graph.
    ``graph_totals`` gives counts without edges.
    """

    def __init__(self, frames, sessions=None, graph_totals=None, edges=None, graphs=None):
        self.frames = frames
        self.sessions = sessions
        self.edges = edges
        self.graphs = graphs
        self.failures: dict[str, str] = {}
        if edges is not None and graphs is None:
            ids = [r[0] for r in edges.select(GR.GRAPH).distinct().limit(2).collect()]
            if len(ids) > 1:
                raise ValueError("several graphs: say in `graphs` which one a session has")
            everyone = frames.select("session_id").distinct()
            self.graphs = everyone.withColumn(GR.GRAPH, F.lit(ids[0] if ids else None))
        self.graph_totals = graph_totals
        if graph_totals is None and graphs is not None:
            self.graph_totals = graphs.join(graph_counts(edges), GR.GRAPH, "left").drop(GR.GRAPH)
        self._paths: dict[tuple, DataFrame] = {}
        self._routes: dict[tuple[str, str], DataFrame] = {}

    def route(self, start_node, end_node) -> DataFrame:
        """(session_id, pos, node) of the shortest path in each session's graph.

        A session whose graph lacks one of the nodes has no row; if there is no
        path between them it has one with a null pos.
        """
        ends = (str(start_node), str(end_node))
        if ends not in self._routes:
            nodes = GR.both_ways(self.edges).select(GR.GRAPH, F.col("u").cast("string").alias("_node"))
            there = nodes.where(F.col("_node").isin(*ends)).groupBy(GR.GRAPH).agg(F.count_distinct("_node").alias("_n"))
            pairs = there.where(F.col("_n") == len(set(ends))).select(
                GR.GRAPH, F.lit(ends[0]).alias("source"), F.lit(ends[1]).alias("target")
            )
            reached = GR.shortest_paths(self.edges, pairs.select(GR.GRAPH, "source"), until=pairs)
            found = GR.path_nodes(pairs, reached).select(GR.GRAPH, "path")
            rows = pairs.join(found, GR.GRAPH, "left").select(GR.GRAPH, F.posexplode_outer("path").alias("pos", "node"))
            self._routes[ends] = materialise(self.graphs.join(rows, GR.GRAPH).drop(GR.GRAPH), "routes")
        return self._routes[ends]

    def paths(self, start_column, start_value, end_column, end_value, min_unique_values=None):
        """Paths of one specification, searched once and shared by all metrics."""
        spec = (start_column, start_value, end_column, end_value, tuple(sorted((min_unique_values or {}).items())))
        if spec not in self._paths:
            found = P.transitions(
                self.frames, start_column, start_value, end_column, end_value, min_distinct=min_unique_values
            )
            self._paths[spec] = materialise(found, "paths")
        return self._paths[spec]


def _value(df: DataFrame, column: str) -> DataFrame:
    return df.select("session_id", "path_id", F.col(column).cast("double").alias("value"))


@session_metric("time_a_to_b")
def _time(frames, context, **spec):
    return _value(P.time_in_path(context.paths(**spec), context.sessions), "seconds")


@session_metric("velocity_a_to_b")
def _velocity(frames, context, x_column="x", y_column="y", pixel_to_meter=None, **spec):
    moved = P.velocity_in_path(
        frames,
        context.paths(**spec),
        x_column,
        y_column,
        sessions=context.sessions,
        pixel_to_meter=pixel_to_meter,
    )
    return _value(moved, "velocity")


@session_metric("num_values_in_path")
def _values(frames, context, count_column, mode="unique", total_values=None, **spec):
    counted = P.values_in_path(
        frames,
        context.paths(**spec),
        count_column,
        mode,
        total=total_values,
        graph_totals=context.graph_totals,
    )
    return _value(counted, "value")


@session_metric("exploration_percentage")
def _exploration(frames, context, location_column, total_locations=None):
    share = exploration(frames, location_column, total_locations, context.graph_totals)
    return share.select(
        "session_id", F.lit(None).cast("bigint").alias("path_id"), F.col("exploration").alias("value")
    )


@session_metric("shortest_path_efficiency")
def _efficiency(
    frames, context, path_column, start_node, end_node, strike_levels=None, max_strikes=0, measure="efficiency", **spec
):
    """One measure of route_scores per path; without a graph that has both
    nodes no path has any."""
    found = context.paths(**spec)
    if context.edges is None:
        return _value(found.where(F.lit(False)), "start_frame")
    route = context.route(start_node, end_node)
    scores = route_scores(
        frames,
        found.join(route.select("session_id").distinct(), "session_id", "left_semi"),
        path_column,
        route,
        strike_levels=strike_levels,
        max_strikes=max_strikes,
    )
    return _value(scores.withColumn("completed", F.col("completed").cast("int")), measure)


def battery(context: Context, wanted: Mapping[str, tuple[str, Mapping]]) -> DataFrame:
    """All wanted metrics of all sessions as (session_id, metric, path_id, value).

    ``wanted`` maps a result name to (metric, arguments). Argument names are
    checked at once. Every metric is written by itself, so that one which fails,
    in its plan or while it runs, gives NULL for every session and the others go
    on; ``context.failures`` keeps the reason.
    """
    parts = []
    for name, (metric, args) in wanted.items():
        fn = SESSION_METRICS[metric]
        inspect.signature(fn).bind(context.frames, context, **args)
        try:
            part = fn(context.frames, context, **args)
            if set(part.columns) != {"session_id", "path_id", "value"}:
                raise ValueError(f"metric {metric} returned {part.columns}")
            part = materialise(part.select("session_id", "path_id", "value"), "metric")
        except (PySparkException, Py4JJavaError, ValueError) as error:
            context.failures[name] = str(error)
            part = context.frames.select("session_id").distinct().select(
                "session_id",
                F.lit(None).cast("bigint").alias("path_id"),
                F.lit(None).cast("double").alias("value"),
            )
        parts.append(part.withColumn("metric", F.lit(name)).select(*METRIC_SCHEMA))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cross_session(metrics: DataFrame, wanted: Mapping[str, tuple[str, Mapping]]) -> dict[str, DataFrame]:
    """The wanted cross-session metrics of a battery's result, by result name."""
    out = {}
    for name, (metric, args) in wanted.items():
        fn = CROSS_METRICS[metric]
        inspect.signature(fn).bind(metrics, **args)
        out[name] = fn(metrics, **args)
    return out


def graph_counts(edges: DataFrame) -> DataFrame:
    """(graph_id, nodes, edges) of every graph."""
    nodes = GR.both_ways(edges).groupBy(GR.GRAPH).agg(F.count_distinct("u").alias("nodes"))
    return nodes.join(edges.groupBy(GR.GRAPH).agg(F.count("*").alias("edges")), GR.GRAPH)


def if_many_sessions(df: DataFrame, sessions: DataFrame, least: int = 2) -> DataFrame:
    """Rows only when there are at least ``least`` sessions."""
    enough = sessions.select(F.count_distinct("session_id").alias("n")).scalar() >= least
    return df.where(enough)


@cross_session_metric("learning_progression")
def learning_progression(metrics: DataFrame, metric_name: str) -> DataFrame:
    """Values of one metric in natural session order, sessions without one left out.

    ``pos`` numbers the sessions; a session with many paths keeps all its values.
    """
    values = metrics.where((F.col("metric") == metric_name) & F.col("value").isNotNull())
    # The key follows the value's order at the end, so equal spellings stay apart.
    ids = values.select("session_id").distinct()
    order = [F.to_json(F.array(natural_key(F.col("session_id").cast("string")))), F.col("session_id")]
    numbered = with_ordinal(ids, [], order, "pos")
    return values.join(numbered, ["session_id"]).select("pos", "session_id", "path_id", "value")
