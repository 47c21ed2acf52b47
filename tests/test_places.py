import math
import random

import pytest
from pyspark.sql import functions as F

from burrow.functions import geometry as G
from burrow.operators import locate as L
from tests.test_paths import table

SCHEMA = (
    "map_id string, ord bigint, region_id string, kind string, points array<struct<x:double,y:double>>, cx double, cy double, "
    "a double, b double, angle double, element_type string, node_id string, u string, v string"
)


def region(ord_, kind, points=None, cx=None, cy=None, a=None, b=None, angle=None, node=None, edge=(None, None), map_id="m"):
    kind_of = "node" if node else "edge"
    values = [None if v is None else float(v) for v in (cx, cy, a, b, angle)]
    points = [(float(x), float(y)) for x, y in points] if points else None
    return (map_id, ord_, f"r{ord_}", kind, points, *values, kind_of, node, *edge)


def inside(r, x, y):
    _, _, _, kind, points, cx, cy, a, b, angle, *_ = r
    if kind == "rectangle":
        return cx <= x <= cx + a and cy <= y <= cy + b
    if kind == "circle":
        return (x - cx) ** 2 + (y - cy) ** 2 <= a * a
    if kind == "ellipse":
        along = (x - cx) * math.cos(angle) + (y - cy) * math.sin(angle)
        across = (y - cy) * math.cos(angle) - (x - cx) * math.sin(angle)
        return (along / a) ** 2 + (across / b) ** 2 <= 1
    if kind == "hexagon":
        points = [(cx + a * math.cos(i * math.pi / 3), cy + a * math.sin(i * math.pi / 3)) for i in range(6)]
    odd = False
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return True
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def random_regions(rng, n=60):
    out = []
    for i in range(n):
        # Sizes from tiny to huge, so that several grid levels are in use.
        size = 10 ** rng.uniform(-1, 1.6)
        x, y = rng.uniform(-30, 30), rng.uniform(-30, 30)
        ends = {"node": f"n{i}"} if i % 3 else {"edge": (f"n{i}", f"n{i + 1}")}
        kind = ["rectangle", "circle", "ellipse", "hexagon", "polygon"][i % 5]
        if kind == "polygon":
            points = [(x + rng.uniform(-1, 1) * size, y + rng.uniform(-1, 1) * size) for _ in range(5)]
            out.append(region(i, kind, points, map_id=f"m{i % 2}", **ends))
        else:
            out.append(region(i, kind, None, x, y, size, size * rng.uniform(0.4, 1), rng.uniform(0, 3), map_id=f"m{i % 2}", **ends))
    return out


@pytest.fixture(scope="module")
def scene(spark):
    rng = random.Random(2)
    rows = random_regions(rng)
    spots = [(f"m{i % 2}", i, rng.uniform(-40, 40), rng.uniform(-40, 40)) for i in range(400)]
    # A hot spot: many points at one place.
    spots += [("m0", 1000 + i, 1.5, 2.5) for i in range(200)] + [("m0", 5000, None, 1.0)]
    points = table(spark, "map_id string, id bigint, x double, y double", spots).cache()
    regions = G.measured(table(spark, SCHEMA, rows)).cache()
    return rows, spots, points, regions


@pytest.mark.parametrize("args", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "target": 20}])
def test_matches_equal_brute_force(scene, args):
    rows, spots, points, regions = scene
    got = sorted((r.id, r.ord) for r in L.matching_regions(points, regions, **args).collect())
    want = sorted((p[1], r[1]) for p in spots for r in rows if p[2] is not None and r[0] == p[0] and inside(r, p[2], p[3]))
    assert got == want and len(got) > 500


@pytest.mark.parametrize("args", [{}, {"crowded": 3}, {"crowded": 0}, {"broadcast_bytes": 0, "target": 20}])
def test_rules_equal_brute_force(scene, args, monkeypatch):
    rows, spots, points, regions = scene
    args = dict(args)
    monkeypatch.setattr(L, "CROWDED", args.pop("crowded", L.CROWDED))
    size = {r.ord: (r.area, r.center_x, r.center_y) for r in regions.collect()}
    orders = {
        "node_priority": lambda r, p: (r[10] != "node", r[1]),
        "edge_priority": lambda r, p: (r[10] == "node", r[1]),
        "smallest_region": lambda r, p: (size[r[1]][0], r[10] != "node", r[1]),
        "largest_region": lambda r, p: (-size[r[1]][0], r[10] != "node", r[1]),
        "nearest_center": lambda r, p: (math.dist(p[2:], size[r[1]][1:]), r[10] != "node", r[1]),
    }
    for rule, order in orders.items():
        out = L.located(points, regions, ["id"], rule, unmapped="none", **args)
        got = {r.id: (r.graph_node, r.graph_u, r.graph_v) for r in out.collect()}
        assert len(got) == len(spots)
        for p in spots:
            hits = [r for r in rows if p[2] is not None and r[0] == p[0] and inside(r, p[2], p[3])]
            if p[2] is None:
                want = (None, None, None)
            elif not hits:
                want = ("none", None, None)
            else:
                best = min(hits, key=lambda r: order(r, p))
                want = (best[11] or "none", best[12], best[13])
            assert got[p[1]] == want, (rule, p)


def test_small_maps_leave_the_points_where_they_are(scene, spark):
    _, _, points, regions = scene
    out = L.located(points, regions, ["id"], "nearest_center")
    plan = out._jdf.queryExecution().executedPlan().toString()
    used, _, most = L.grid_statistics(regions)
    assert plan.count("BroadcastExchange") == len(used) and most <= L.CROWDED
    assert " Exchange " not in plan and "Generate" not in plan


def test_points_of_many_maps_are_sent_once(scene, spark):
    _, _, points, regions = scene
    out = L.located(points, regions, ["id"], "nearest_center", broadcast_bytes=0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # not once per grid level


@pytest.mark.parametrize("target", [1 << 20, 20])
def test_points_of_many_maps_are_not_sorted(scene, spark, target):
    _, _, points, regions = scene
    out = L.located(points, regions, ["id"], "smallest_region", target=target, broadcast_bytes=0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("crowded, target", [(3, 1 << 20), (1 << 20, 20)])
def test_maps_beyond_the_bound_win_alike(scene, spark, monkeypatch, crowded, target):
    _, _, points, regions = scene
    want = sorted(map(str, L.located(points, regions, ["id"], "smallest_region").collect()))
    monkeypatch.setattr(L, "CROWDED", crowded)
    got = L.located(points, regions, ["id"], "smallest_region", target=target, broadcast_bytes=0)
    assert sorted(map(str, got.collect())) == want


def test_directions_bound_every_shape(spark):
    rows = random_regions(random.Random(5))
    regions = G.measured(table(spark, SCHEMA, rows))
    ends = {f"{e}{k}": G.reach(d)[i] for k, d in enumerate(G.DIRECTIONS) for i, e in enumerate(("low", "high"))}
    draw = random.Random(6)
    for r in regions.withColumns(ends).collect():
        spots = [(draw.uniform(r.x0, r.x1), draw.uniform(r.y0, r.y1)) for _ in range(300)]
        held = [p for p in spots if inside(rows[r.ord], *p)]
        for k, d in enumerate(G.DIRECTIONS):
            places = [x * math.cos(d) + y * math.sin(d) for x, y in held]
            assert all(r[f"low{k}"] - 1e-9 <= x <= r[f"high{k}"] + 1e-9 for x in places), (r.kind, d)


def test_conflict_rules_golden(spark):
    node = region(0, "rectangle", None, 0, 0, 2, 2, node="n")
    edge = region(1, "polygon", [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)], edge=("a", "b"))
    regions = G.measured(table(spark, SCHEMA, [node, edge]))
    point = table(spark, "map_id string, id bigint, x double, y double", [("m", 1, 1.0, 1.25)])
    want = {"node_priority": "n", "edge_priority": None, "smallest_region": None, "largest_region": "n", "first_found": "n"}
    for rule, value in want.items():
        r = L.located(point, regions, ["id"], rule).first()
        assert (r.graph_node, r.graph_u) == (value, None if value else "a")
    with pytest.raises(Exception):
        L.located(point, regions, ["id"], "raise_error").collect()
    lone = table(spark, "map_id string, id bigint, x double, y double", [("m", 1, 0.25, 0.25)])
    assert L.located(lone, regions, ["id"], "raise_error").first().graph_node == "n"
    with pytest.raises(ValueError):
        L.located(point, regions, ["id"], "coin_toss")


def test_overlaps_equal_brute_force(scene):
    rows, _, _, regions = scene
    box = {r.ord: (r.x0, r.y0, r.x1, r.y1) for r in regions.collect()}
    want = []
    for i, p in enumerate(rows):
        for q in rows[i + 1:]:
            (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = box[p[1]], box[q[1]]
            if p[0] != q[0] or ax1 < bx0 or bx1 < ax0 or ay1 < by0 or by1 < ay0:
                continue
            left, right, low, high = max(ax0, bx0), min(ax1, bx1), max(ay0, by0), min(ay1, by1)

            def at(a, b, i):
                return b if i == 9 else a + (b - a) / 9 * i

            if any(inside(p, at(left, right, i), at(low, high, j)) and inside(q, at(left, right, i), at(low, high, j)) for i in range(10) for j in range(10)):
                want.append((p[2], q[2]))
    got = [(r.region1, r.region2) for r in L.overlapping_regions(regions).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20


def test_offset_golden(spark):
    square = region(0, "polygon", [(100, 100), (150, 100), (150, 150), (100, 150)], node="n")
    still = region(1, "rectangle", None, 165, 100, 10, 10, node="k")
    regions = G.measured(table(spark, SCHEMA, [square, still]))
    offsets = table(spark, "map_id string, region_id string, dx double, dy double", [("m", "r0", 20.0, 10.0)])
    moved = {r.region_id: r for r in L.shifted(regions, offsets).collect()}
    assert tuple(moved["r0"].points[0]) == (120.0, 110.0)
    assert (moved["r0"].x0, moved["r0"].center_x, moved["r1"].x0) == (120.0, 145.0, 165.0)
    # Boxes that only touch do not collide.
    touch = offsets.withColumn("dx", F.lit(15.0))
    assert L.offset_collisions(regions, touch).isEmpty()
    assert [(r.moved, r.hit) for r in L.offset_collisions(regions, offsets.withColumn("dy", F.lit(0.0))).collect()] == [("r0", "r1")]


def test_flat_polygon_has_the_mean_of_its_corners_as_centre(spark):
    regions = G.measured(table(spark, SCHEMA, [region(0, "polygon", [(0, 0), (2, 2), (4, 4)], node="n")]))
    r = regions.first()
    assert (r.area, r.center_x, r.center_y) == (0.0, 2.0, 2.0)


def test_grid_neighbours_need_4_or_8(spark):
    grids = table(spark, "map_id string, rows int, cols int, cell_w double, cell_h double, origin_x double, origin_y double", [("m", 2, 3, 1.0, 1.0, 0.0, 0.0)])
    cells = L.grid_cells(grids)
    assert cells.count() == 6
    assert L.grid_neighbours(cells, 4).count() == 14
    assert L.grid_neighbours(cells, 8).count() == 22
    with pytest.raises(ValueError):
        L.grid_neighbours(cells, 6)
