"""Points to graph elements: the spatial join and its conflict rules; map checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burrow.functions import geometry as G
from burrow.functions.projective import project
from burrow.operators.skew import TARGET_ROWS, salted_join
from burrow.session import materialise

MAP = "map_id"
CELL = ("_level", "_col", "_row")
ELEMENT = ("element_type", "node_id", "u", "v")

BROADCAST_BYTES = 64 << 20
#: Regions of a cell that a point is tested against in its own row.
CROWDED = 256
ROW_BYTES = 250
SIDE_BYTES = 48


def edge_key(u: str | Column = "u", v: str | Column = "v") -> Column:
    """Undirected edge identity."""
    return F.array_sort(F.array(u, v))


# -- grid cells ---------------------------------------------------------------

def _level_of(extent: Column) -> Column:
    # Cells of level n are 4**n wide; a region sits on the first level whose
    # cells are at least its own size, so it touches four cells at most.
    return F.ceil(F.log(F.greatest(extent, F.lit(1e-6))) / F.log(F.lit(4.0))).cast("int")


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(4.0), level))


def region_cells(regions: DataFrame) -> DataFrame:
    """One row per region and grid cell it touches."""
    df = regions.withColumn("_level", _level_of(_extent()))
    level = F.col("_level")
    slack = 1e-9
    return df.withColumn(
        "_col", F.explode(F.sequence(_cell(F.col("x0") - slack, level), _cell(F.col("x1") + slack, level)))
    ).withColumn(
        "_row", F.explode(F.sequence(_cell(F.col("y0") - slack, level), _cell(F.col("y1") + slack, level)))
    )


def _extent() -> Column:
    return F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))


def grid_statistics(regions: DataFrame) -> tuple[list[int], int, int]:
    """Grid levels in use, the bytes of the regions' cell rows, and the most
    regions in one cell.

    There is one level per factor of four in region size, so only a few.
    """
    sides = F.greatest(F.coalesce(F.size("edges"), F.lit(0)), F.lit(0))
    rows = (
        region_cells(regions.select(MAP, "edges", "x0", "y0", "x1", "y1"))
        .groupBy(MAP, *CELL)
        .agg(F.count("*").alias("n"), F.sum(F.lit(ROW_BYTES) + sides * SIDE_BYTES).alias("bytes"))
        .groupBy("_level")
        .agg(F.sum("bytes").alias("bytes"), F.max("n").alias("n"))
        .collect()
    )
    return sorted(r["_level"] for r in rows) or [0], sum(r.bytes for r in rows), max((r.n for r in rows), default=0)


def _near_regions(
    points: DataFrame, regions: DataFrame, x: str, y: str, target: int, broadcast_bytes: int, grid=None
) -> DataFrame:
    """Every point once per grid level, with the regions of its cell (or none).

    A small map is broadcast, so the points are not shuffled. Beyond the bound
    the cells are joined by shuffle, with cells full of points salted.
    """
    used, size, _ = grid or grid_statistics(regions)
    probes = points.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in used])))
    level = F.col("_level")
    probes = probes.withColumns({"_col": _cell(F.col(x), level), "_row": _cell(F.col(y), level)})
    shapes = regions.select(
        MAP, "ord", "region_id", *ELEMENT, *[c for c in G.SHAPE if c != "points"], *G.MEASURES
    )
    cells = region_cells(shapes)
    if size <= broadcast_bytes:
        return probes.join(F.broadcast(cells), [MAP, *CELL], "left")
    vary = [c for c in points.columns if c != MAP]
    return salted_join(probes, cells, [MAP, *CELL], vary, "left", target)


def matching_regions(
    points: DataFrame,
    regions: DataFrame,
    x="x",
    y="y",
    target: int = TARGET_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """All (point, region) pairs in which the region holds the point."""
    seen = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    near = _near_regions(seen, regions, x, y, target, broadcast_bytes)
    return near.where(G.contains(F.col(x), F.col(y))).select(
        *points.columns, "region_id", "ord", *ELEMENT, "area", "center_x", "center_y"
    )


# -- conflict rules -----------------------------------------------------------

def _node_first(r) -> Column:
    return (r["element_type"] != "node").cast("int")


#: Each rule orders the matches of a point; the first one wins. A rule is a
#: function of the point's coordinate columns and of the region's, by name.
RULES: dict[str, Callable] = {
    "node_priority": lambda x, y, r: [_node_first(r)],
    "edge_priority": lambda x, y, r: [-_node_first(r)],
    "smallest_region": lambda x, y, r: [r["area"], _node_first(r)],
    "largest_region": lambda x, y, r: [-r["area"], _node_first(r)],
    "nearest_center": lambda x, y, r: [F.hypot(x - r["center_x"], y - r["center_y"]), _node_first(r)],
    "first_found": lambda x, y, r: [_node_first(r)],
    "raise_error": lambda x, y, r: [_node_first(r)],
}
REGION = ("ord", "region_id", *ELEMENT, *[c for c in G.SHAPE if c != "points"], *G.MEASURES)


def _ranked(order: Callable, x: Column, y: Column, region) -> Column:
    """What a match is compared by, and the element it stands for."""
    rank = [c.alias(f"_k{i}") for i, c in enumerate(order(x, y, region))]
    return F.struct(*rank, *[region[c].alias(c) for c in ("ord", "node_id", "u", "v")])


class _Row:
    """The region's columns of a row, by name."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


def _won_in_rows(points: DataFrame, regions: DataFrame, order: Callable, x: str, y: str, used: list[int], most: int) -> DataFrame:
    """``points`` with ``_won``, ``_n`` and ``_open``: whether a cell of the
    point is crowded, so that its winner isn't known here.

    A cell is one broadcast row with its regions as an array, one join per grid
    level finds the point's cell of that level, and the winner is a minimum
    inside the row: points are neither repeated nor shuffled.
    """
    cells = region_cells(regions.select(MAP, *REGION))
    held = F.struct(*REGION)
    if most > CROWDED:  # nothing of a crowded cell is collected but that it is one
        few = F.count("*").over(Window.partitionBy(MAP, *CELL)) <= CROWDED
        cells, held = cells.withColumn("_few", few), F.when(F.col("_few"), held)
    else:
        cells = cells.withColumn("_few", F.lit(True))
    lists = cells.groupBy(MAP, *CELL).agg(F.collect_list(held).alias("_held"), F.bool_and("_few").alias("_few"))
    lists = materialise(lists, "cells")
    held, open_ = [], []
    px, py = F.col(x), F.col(y)
    for k, n in enumerate(used):
        level = F.lit(n)
        found = lists.where(F.col("_level") == n).select(
            F.col(MAP).alias(f"_m{k}"), F.col("_col").alias(f"_c{k}"), F.col("_row").alias(f"_r{k}"),
            F.col("_held").alias(f"_held{k}"), (~F.col("_few")).alias(f"_open{k}"),
        )
        here = (F.col(MAP) == F.col(f"_m{k}")) & (_cell(px, level) == F.col(f"_c{k}")) & (_cell(py, level) == F.col(f"_r{k}"))
        points = points.join(F.broadcast(found), here, "left").drop(f"_m{k}", f"_c{k}", f"_r{k}")
        held.append(F.filter(f"_held{k}", lambda r: G.contains(px, py, lambda c: r[c])))
        open_.append(F.coalesce(f"_open{k}", F.lit(False)))
    best = [F.array_min(F.transform(h, lambda r: _ranked(order, px, py, r))) for h in held]
    none = F.lit(0)
    return points.withColumns(
        {
            "_won": F.least(*best) if len(best) > 1 else best[0],
            "_n": sum((F.greatest(F.coalesce(F.size(h), none), none) for h in held), none),
            "_open": reduce(lambda a, b: a | b, open_),
        }
    ).drop(*[f"_held{k}" for k in range(len(used))], *[f"_open{k}" for k in range(len(used))])


def _won_by_map(
    points: DataFrame, regions: DataFrame, keys: Sequence[str], order: Callable, x: str, y: str, target: int, most: int
) -> DataFrame:
    """The same for any number of maps: a map of at most ``CROWDED`` regions is
    one row with its regions as an array, which its points are sent to once.

    A task looks its maps up in memory, so the points aren't sorted.
    """
    held = F.struct(*REGION)
    lists = regions.select(MAP, *REGION)
    if most > CROWDED:  # nothing of a crowded map is collected but that it is one
        few = F.count("*").over(Window.partitionBy(MAP)) <= CROWDED
        lists, held = lists.withColumn("_few", few), F.when(F.col("_few"), held)
    else:
        lists = lists.withColumn("_few", F.lit(True))
    lists = lists.groupBy(MAP).agg(F.collect_list(held).alias("_held"), (~F.bool_and("_few")).alias("_open"))
    met = salted_join(points, lists, [MAP], [c for c in (*keys, x, y) if c != MAP], "left", target, hashed=True)
    px, py = F.col(x), F.col(y)
    met = met.withColumn("_hits", F.filter("_held", lambda r: G.contains(px, py, lambda c: r[c]))).drop("_held")
    return met.withColumns(
        {
            "_won": F.array_min(F.transform("_hits", lambda r: _ranked(order, px, py, r))),
            "_n": F.greatest(F.coalesce(F.size("_hits"), F.lit(0)), F.lit(0)),
            "_open": F.coalesce("_open", F.lit(False)),
        }
    ).drop("_hits")


def _won_by_shuffle(
    points: DataFrame, regions: DataFrame, keys: Sequence[str], order: Callable, x: str, y: str, target: int, broadcast_bytes: int, grid
) -> DataFrame:
    """The same for maps or cells of any size: matches are reduced where they
    arise, before the shuffle on the point."""
    near = _near_regions(points, regions, x, y, target, broadcast_bytes, grid)
    px, py = F.col(x), F.col(y)
    match = F.when(F.col("region_id").isNotNull() & G.contains(px, py), _ranked(order, px, py, _Row()))
    return (
        near.select(MAP, *keys, x, y, match.alias("_match"))
        .groupBy(MAP, *keys, x, y)
        .agg(F.min("_match").alias("_won"), F.count("_match").alias("_n"))
    )


def located(
    points: DataFrame,
    regions: DataFrame,
    keys: Sequence[str],
    rule: str | Callable = "node_priority",
    x="x",
    y="y",
    unmapped=None,
    target: int = TARGET_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per point with graph_node or the edge graph_u–graph_v.

    ``keys`` identify a point. Where a count shows that the maps are small enough
    to broadcast, a point meets the regions of its cells inside its row; beyond
    the bound it meets those of its map, after one shuffle. Only points of cells
    or maps with more than ``CROWDED`` regions are repeated per grid level.
    """
    if isinstance(rule, str) and rule not in RULES:
        raise ValueError(f"unknown conflict rule {rule!r}, known: {sorted(RULES)}")
    order = RULES[rule] if isinstance(rule, str) else rule
    px, py = F.col(x), F.col(y)
    asked = points.select(MAP, *keys, x, y)
    used, size, most = grid = grid_statistics(regions)
    by_shuffle = (regions, keys, order, x, y, target, broadcast_bytes, grid)
    if size > broadcast_bytes:
        most = regions.groupBy(MAP).count().agg(F.max("count")).first()[0] or 0
        won = _won_by_map(asked, regions, keys, order, x, y, target, most)
    else:
        won = _won_in_rows(asked, regions, order, x, y, used, most)
    if most > CROWDED:
        rest = won.where("_open").drop("_won", "_n", "_open")
        won = won.where("NOT _open").drop("_open").unionByName(_won_by_shuffle(rest, *by_shuffle))
    node = F.col("_won.node_id")
    if rule == "raise_error":
        # In a filter, so that it acts whichever columns are read.
        fault = F.raise_error(F.lit("a point lies in several regions")).cast("boolean")
        won = won.where(F.when(F.col("_n") > 1, fault).otherwise(True))
    missing = (px.isNull() | py.isNull())
    return won.select(
        MAP,
        *keys,
        x,
        y,
        F.when(missing, None).otherwise(F.coalesce(node, F.lit(unmapped).cast("string"))).alias("graph_node"),
        F.col("_won.u").alias("graph_u"),
        F.col("_won.v").alias("graph_v"),
    )


def located_pose(
    pose: DataFrame,
    calibration: DataFrame | None,
    regions: DataFrame,
    rule: str | Callable = "node_priority",
    unmapped=None,
    target: int = TARGET_ROWS,
) -> DataFrame:
    """Graph location of every bodypart of every frame.

    Each session is its own map here: ``regions.map_id`` is the session.
    """
    rows = pose.withColumn(MAP, F.col("session_id"))
    if calibration is not None:
        matrices = calibration.select("session_id", F.col("h").alias("_h"))
        px, py = project(F.col("_h"), F.col("x"), F.col("y"))
        rows = rows.join(matrices, ["session_id"], "left").withColumns({"map_x": px, "map_y": py})
        x, y = "map_x", "map_y"
    else:
        x, y = "x", "y"
    keys = ["session_id", "frame_number", "bodypart"]
    return located(rows, regions, keys, rule, x, y, unmapped, target).drop(MAP)


# -- grids of rectangles ------------------------------------------------------

NEIGHBOURS = {
    4: [(-1, 0), (1, 0), (0, -1), (0, 1)],
    8: [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)],
}


def grid_cells(grids: DataFrame) -> DataFrame:
    """Cells of grids given as (map_id, rows, cols, cell_w, cell_h, origin_x, origin_y)."""
    cells = grids.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn(
        "col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1))
    )
    return cells.select(
        MAP,
        F.concat_ws("_", F.lit("cell"), "row", "col").alias("region_id"),
        "row",
        "col",
        (F.col("origin_x") + F.col("col") * F.col("cell_w")).alias("cx"),
        (F.col("origin_y") + F.col("row") * F.col("cell_h")).alias("cy"),
        F.col("cell_w").alias("a"),
        F.col("cell_h").alias("b"),
        "rows",
        "cols",
    )


def grid_neighbours(cells: DataFrame, connectivity: int = 4) -> DataFrame:
    """Neighbouring cells inside the grid."""
    if connectivity not in NEIGHBOURS:
        raise ValueError(f"connectivity must be 4 or 8, got {connectivity}")
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in NEIGHBOURS[connectivity]])
    moved = cells.withColumn("_step", F.explode(steps)).withColumns(
        {"to_row": F.col("row") + F.col("_step.r"), "to_col": F.col("col") + F.col("_step.c")}
    )
    return moved.where(
        F.col("to_row").between(0, F.col("rows") - 1) & F.col("to_col").between(0, F.col("cols") - 1)
    ).select(MAP, "row", "col", "to_row", "to_col")


def grid_cell_of(points: DataFrame, grids: DataFrame, x="x", y="y") -> DataFrame:
    """Cell of each point by arithmetic, without a spatial join; NULL off the grid."""
    joined = points.join(grids, [MAP], "left")
    col = F.floor((F.col(x) - F.col("origin_x")) / F.col("cell_w")).cast("int")
    row = F.floor((F.col(y) - F.col("origin_y")) / F.col("cell_h")).cast("int")
    inside = col.between(0, F.col("cols") - 1) & row.between(0, F.col("rows") - 1)
    name = F.concat_ws("_", F.lit("cell"), row, col)
    return joined.withColumn("cell", F.when(inside, name)).select(*points.columns, "cell")


# -- lookups, checks and statistics ---------------------------------------------

def regions_of_nodes(wanted: DataFrame, regions: DataFrame) -> DataFrame:
    return wanted.join(
        regions.where("element_type = 'node'").select(MAP, "node_id", "region_id"), [MAP, "node_id"]
    )


def regions_of_edges(wanted: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions of edges named in either direction."""
    keyed = regions.where("element_type = 'edge'").select(MAP, edge_key().alias("_edge"), "region_id")
    return wanted.withColumn("_edge", edge_key()).join(keyed, [MAP, "_edge"]).drop("_edge")


def unmapped_nodes(nodes: DataFrame, regions: DataFrame) -> DataFrame:
    mapped = regions.where("element_type = 'node'").select(MAP, "node_id")
    return nodes.join(mapped, [MAP, "node_id"], "left_anti")


def unmapped_edges(edges: DataFrame, regions: DataFrame) -> DataFrame:
    mapped = regions.where("element_type = 'edge'").select(MAP, edge_key().alias("_edge"))
    return edges.withColumn("_edge", edge_key()).join(mapped, [MAP, "_edge"], "left_anti").drop("_edge")


def mapped_elements(nodes: DataFrame, edges: DataFrame, regions: DataFrame) -> DataFrame:
    """Graph elements, nodes and edges in one list, and whether a region holds them."""
    n = nodes.select(MAP, F.lit("node").alias("element_type"), F.array("node_id").alias("_id"))
    e = edges.select(MAP, F.lit("edge").alias("element_type"), edge_key().alias("_id"))
    held = regions.select(
        MAP,
        "element_type",
        F.when(F.col("element_type") == "node", F.array("node_id")).otherwise(edge_key()).alias("_id"),
    ).distinct()
    return (
        n.unionByName(e)
        .join(held.withColumn("_held", F.lit(True)), [MAP, "element_type", "_id"], "left")
        .select(MAP, "element_type", F.array_join("_id", "-").alias("element"), F.coalesce("_held", F.lit(False)).alias("mapped"))
    )


def _box_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of boxes on one map that share a point, each pair once.

    Boxes meet in a cell of the coarser of their two levels. A pair is kept in
    the one cell that holds the lower corner of its common box.
    """
    used = {*grid_statistics(left)[0]}
    if right is not left:
        used |= {*grid_statistics(right)[0]}
    ladder = F.array(*[F.lit(n) for n in sorted(used)])

    def cells(df: DataFrame, side: str) -> DataFrame:
        out = df.withColumn("_own", _level_of(_extent())).withColumn(
            "_level", F.explode(F.filter(ladder, lambda n: n >= F.col("_own")))
        )
        level = F.col("_level")
        out = out.withColumn("_col", F.explode(F.sequence(_cell(F.col("x0"), level), _cell(F.col("x1"), level))))
        out = out.withColumn("_row", F.explode(F.sequence(_cell(F.col("y0"), level), _cell(F.col("y1"), level))))
        data = [c for c in out.columns if c not in (MAP, *CELL)]
        return out.select(MAP, *CELL, F.struct(*data).alias(side))

    a, b = cells(left, "p"), cells(right, "q")
    joined = salted_join(a, b, [MAP, *CELL], ["p.ord"])
    p, q = F.col("p"), F.col("q")
    level = F.col("_level")
    corner_x, corner_y = F.greatest(p["x0"], q["x0"]), F.greatest(p["y0"], q["y0"])
    return joined.where(
        (F.greatest(p["_own"], q["_own"]) == level)
        & (p["x0"] <= q["x1"]) & (q["x0"] <= p["x1"]) & (p["y0"] <= q["y1"]) & (q["y0"] <= p["y1"])
        & (_cell(corner_x, level) == F.col("_col"))
        & (_cell(corner_y, level) == F.col("_row"))
    )


def overlapping_regions(regions: DataFrame, samples: int = 10) -> DataFrame:
    """Pairs of regions of a map that overlap.

    Two regions overlap if a point of a grid of samples×samples over their
    common box, its borders included, lies in both. Two rectangles always do.
    Pairs that a line parts in one of the directions of ``G.DIRECTIONS`` can't,
    and are told by comparing each region's reach, which is taken once per
    region; only what is left is tested at the points, from the middle of the
    box outwards, where most pairs meet.
    """
    reaches = {f"_{end}{k}": G.reach(d)[i] for k, d in enumerate(G.DIRECTIONS) for i, end in enumerate(("low", "high"))}
    rows = regions.select(MAP, "ord", "region_id", *[c for c in G.SHAPE if c != "points"], *G.MEASURES).withColumns(reaches)
    rows = materialise(rows, "reaches")
    pairs = _box_pairs(rows, rows).where(F.col("p.ord") < F.col("q.ord"))
    p, q = F.col("p"), F.col("q")
    sides = [(k, *pq) for k in range(len(G.DIRECTIONS)) for pq in ("pq", "qp")]
    # Reaches are rounded, so a gap has to be wider than that.
    parted = F.expr(" OR ".join(f"{a}._low{k} > {b}._high{k} + 1e-9D * (1 + abs({a}._low{k}) + abs({b}._high{k}))" for k, a, b in sides))
    pairs = pairs.where(~F.coalesce(parted, F.lit(False)))
    last = samples - 1

    def places(start: Column, stop: Column) -> Column:
        step = (stop - start) / last
        return F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: F.when(i == last, stop).otherwise(start + step * i))

    xs = places(F.greatest(p["x0"], q["x0"]), F.least(p["x1"], q["x1"]))
    ys = places(F.greatest(p["y0"], q["y0"]), F.least(p["y1"], q["y1"]))
    order = sorted(range(samples * samples), key=lambda i: max(abs(i // samples - last / 2), abs(i % samples - last / 2)))
    outwards = F.expr(f"array({', '.join(map(str, order))})")
    # Few bytes but much work per pair: keep the pairs spread over all tasks. They
    # are written with their places, which would else be taken anew for every point.
    tasks = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = materialise(pairs.withColumns({"_xs": xs, "_ys": ys}).repartition(tasks, "p.region_id", "q.region_id"), "pairs")
    spots = F.transform(outwards, lambda n: F.struct(F.get("_xs", F.floor(n / samples)).alias("x"), F.get("_ys", n % samples).alias("y")))
    both = F.exists(spots, lambda at: G.contains(at["x"], at["y"], "p.") & G.contains(at["x"], at["y"], "q."))
    rectangles = (p["kind"] == "rectangle") & (q["kind"] == "rectangle")
    return pairs.where(rectangles | both).select(
        MAP, F.col("p.region_id").alias("region1"), F.col("q.region_id").alias("region2"), F.lit(1.0).alias("severity")
    )


def node_conflicts(assigned: DataFrame) -> DataFrame:
    """Regions given to several nodes: one row per region and node, with their number.

    Any two nodes of a region conflict; they are listed, not paired, so a region
    with many nodes stays linear.
    """
    pairs = assigned.select(MAP, "region_id", "node_id").distinct()
    many = pairs.groupBy(MAP, "region_id").agg(F.count("*").alias("nodes")).where("nodes > 1")
    return pairs.join(many, [MAP, "region_id"])


def mapping_statistics(nodes: DataFrame, edges: DataFrame, regions: DataFrame) -> DataFrame:
    """Totals, completeness and coverage of each map."""
    parts = mapped_elements(nodes, edges, regions)
    is_node, is_edge, held = F.col("element_type") == "node", F.col("element_type") == "edge", F.col("mapped")
    counts = parts.groupBy(MAP).agg(
        F.count_if(is_node).alias("total_nodes"),
        F.count_if(is_node & held).alias("mapped_nodes"),
        F.count_if(is_edge).alias("total_edges"),
        F.count_if(is_edge & held).alias("mapped_edges"),
    )
    pairs = overlapping_regions(regions)
    touched = pairs.select(MAP, F.explode(F.array("region1", "region2")).alias("region_id")).distinct()
    over = touched.groupBy(MAP).agg(F.count("*").alias("_over"))
    sizes = regions.groupBy(MAP).agg(F.count("*").alias("_regions"))
    zero = F.lit(0).cast("bigint")
    total = F.col("total_nodes") + F.col("total_edges")
    done = F.col("mapped_nodes") + F.col("mapped_edges")

    def share(part: Column, whole: Column, empty: float) -> Column:
        return F.when(whole > 0, part / whole * 100).otherwise(F.lit(empty))

    return (
        counts.join(sizes, [MAP], "left")
        .join(over, [MAP], "left")
        .withColumns(
            {
                "unmapped_nodes": F.col("total_nodes") - F.col("mapped_nodes"),
                "unmapped_edges": F.col("total_edges") - F.col("mapped_edges"),
                "total_regions": F.coalesce("_regions", zero),
                "overlapping_regions": F.coalesce("_over", zero),
                "node_completeness": share(F.col("mapped_nodes"), F.col("total_nodes"), 100.0),
                "edge_completeness": share(F.col("mapped_edges"), F.col("total_edges"), 100.0),
                "coverage": share(done, total, 0.0),
            }
        )
        .drop("_regions", "_over")
    )


def shifted(regions: DataFrame, offsets: DataFrame) -> DataFrame:
    """Regions moved by their (dx, dy); measures are taken anew."""
    base = regions.drop(*G.MEASURES)
    moved = base.join(offsets.select(MAP, "region_id", "dx", "dy"), [MAP, "region_id"], "left")
    dx, dy = F.coalesce("dx", F.lit(0.0)), F.coalesce("dy", F.lit(0.0))
    points = F.transform("points", lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))
    moved = moved.withColumns({"points": points, "cx": F.col("cx") + dx, "cy": F.col("cy") + dy})
    return G.measured(moved.drop("dx", "dy")).select(*[c for c in regions.columns])


def offset_collisions(regions: DataFrame, offsets: DataFrame) -> DataFrame:
    """Moved regions whose box now cuts into the box of a region that stayed."""
    box = [MAP, "ord", "region_id", "edges", "x0", "y0", "x1", "y1"]
    moved_ids = offsets.select(MAP, "region_id")
    moved = shifted(regions, offsets).join(moved_ids, [MAP, "region_id"], "left_semi").select(*box)
    stayed = regions.join(moved_ids, [MAP, "region_id"], "left_anti").select(*box)
    p, q = F.col("p"), F.col("q")
    cut = (p["x0"] < q["x1"]) & (q["x0"] < p["x1"]) & (p["y0"] < q["y1"]) & (q["y0"] < p["y1"])
    return _box_pairs(moved, stayed).where(cut).select(
        MAP, p["region_id"].alias("moved"), q["region_id"].alias("hit")
    )


def reprojection_error(pairs: DataFrame, calibration: DataFrame, least: int = 4) -> DataFrame:
    """Mean distance of projected source points to their targets, per session."""
    px, py = project(F.col("h"), F.col("src_x"), F.col("src_y"))
    off = F.hypot(px - F.col("dst_x"), py - F.col("dst_y"))
    return (
        pairs.join(calibration.select("session_id", "h"), ["session_id"])
        .groupBy("session_id")
        .agg(F.avg(off).alias("error"), F.count("*").alias("point_pairs"))
        .where(F.col("point_pairs") >= least)
    )


def builder_mismatches(stored: DataFrame, current: DataFrame, regions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Why a stored map does not fit the present graph: one row per reason.

    ``stored`` and ``current`` are (map_id, builder, params MAP<STRING,STRING>).
    """
    both = stored.alias("s").join(current.alias("c"), [MAP])
    builder = both.where(F.col("s.builder") != F.col("c.builder")).select(
        MAP, F.lit("builder").alias("reason"), F.concat_ws("/", "s.builder", "c.builder").alias("detail")
    )
    names = F.array_distinct(F.concat(F.map_keys("s.params"), F.map_keys("c.params")))
    params = (
        both.where(F.col("s.builder") == F.col("c.builder"))
        .withColumn("_name", F.explode(names))
        .where(~F.col("s.params")[F.col("_name")].eqNullSafe(F.col("c.params")[F.col("_name")]))
        .select(MAP, F.lit("parameter").alias("reason"), F.col("_name").alias("detail"))
    )
    strangers = (
        regions.where("element_type = 'node'")
        .select(MAP, "node_id")
        .distinct()
        .join(nodes.select(MAP, "node_id"), [MAP, "node_id"], "left_anti")
        .select(MAP, F.lit("unknown node").alias("reason"), F.col("node_id").alias("detail"))
    )
    return builder.unionByName(params).unionByName(strangers)
