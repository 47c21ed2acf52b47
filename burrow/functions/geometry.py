"""Region shapes as column expressions.

A region row has ``kind`` and the columns of its shape:
    polygon    points                      rectangle  cx, cy = corner; a, b = width, height
    circle     cx, cy, a = radius          hexagon    cx, cy, a = radius
    ellipse    cx, cy, a, b = radii, angle (radians)
``measured`` adds what every later test needs, once per region.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROOT3 = math.sqrt(3.0)
OUTLINED = ("polygon", "hexagon")
SHAPE = ("kind", "points", "cx", "cy", "a", "b", "angle")
MEASURES = ("edges", "x0", "y0", "x1", "y1", "center_x", "center_y", "area")


def _by_kind(**cases: Column) -> Column:
    out = F.lit(None)
    for kind, value in cases.items():
        out = F.when(F.col("kind") == kind, value).otherwise(out)
    return out


def hexagon_points(cx: Column, cy: Column, radius: Column) -> Column:
    """Six corners at steps of 60 degrees, the first to the right of the centre."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(5)),
        lambda i: F.struct(
            (cx + radius * F.cos(i * (math.pi / 3))).alias("x"),
            (cy + radius * F.sin(i * (math.pi / 3))).alias("y"),
        ),
    )


def outline_edges(points: Column) -> Column:
    """Sides of a closed outline as (x1, y1, x2, y2)."""
    turned = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    return F.zip_with(
        points,
        turned,
        lambda p, q: F.struct(
            p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")
        ),
    )


def _total(edges: Column, term) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + term(e))


def _cross(e: Column) -> Column:
    return e["x1"] * e["y2"] - e["x2"] * e["y1"]


def measured(regions: DataFrame) -> DataFrame:
    """Add outline sides, bounding box, centre and area to region rows."""
    cx, cy, a, b, angle, pts = (F.col(c) for c in ("cx", "cy", "a", "b", "angle", "points"))
    outline = F.when(F.col("kind") == "hexagon", hexagon_points(cx, cy, a)).when(
        F.col("kind") == "polygon", pts
    )
    df = regions.withColumn("edges", outline_edges(outline))
    edges = F.col("edges")
    df = df.withColumns(
        {
            "_twice": _total(edges, _cross),
            "_mx": _total(edges, lambda e: (e["x1"] + e["x2"]) * _cross(e)),
            "_my": _total(edges, lambda e: (e["y1"] + e["y2"]) * _cross(e)),
        }
    )
    xs, ys = F.transform("edges", lambda e: e["x1"]), F.transform("edges", lambda e: e["y1"])
    corners = F.size("edges")
    flat = F.col("_twice") == 0
    half_w = F.sqrt(F.pow(a * F.cos(angle), 2) + F.pow(b * F.sin(angle), 2))
    half_h = F.sqrt(F.pow(a * F.sin(angle), 2) + F.pow(b * F.cos(angle), 2))
    hex_h = a * (ROOT3 / 2)
    measures = {
        "x0": _by_kind(polygon=F.array_min(xs), rectangle=cx, circle=cx - a, hexagon=cx - a, ellipse=cx - half_w),
        "y0": _by_kind(polygon=F.array_min(ys), rectangle=cy, circle=cy - a, hexagon=cy - hex_h, ellipse=cy - half_h),
        "x1": _by_kind(polygon=F.array_max(xs), rectangle=cx + a, circle=cx + a, hexagon=cx + a, ellipse=cx + half_w),
        "y1": _by_kind(polygon=F.array_max(ys), rectangle=cy + b, circle=cy + a, hexagon=cy + hex_h, ellipse=cy + half_h),
        "center_x": _by_kind(
            polygon=F.when(flat, _total(edges, lambda e: e["x1"]) / corners).otherwise(
                F.try_divide(F.col("_mx"), 3 * F.col("_twice"))
            ),
            rectangle=cx + a / 2, circle=cx, hexagon=cx, ellipse=cx,
        ),
        "center_y": _by_kind(
            polygon=F.when(flat, _total(edges, lambda e: e["y1"]) / corners).otherwise(
                F.try_divide(F.col("_my"), 3 * F.col("_twice"))
            ),
            rectangle=cy + b / 2, circle=cy, hexagon=cy, ellipse=cy,
        ),
        "area": _by_kind(
            polygon=F.abs(F.col("_twice")) / 2, rectangle=a * b, circle=math.pi * a * a,
            hexagon=(1.5 * ROOT3) * a * a, ellipse=math.pi * a * b,
        ),
    }
    return df.withColumns(measures).drop("_twice", "_mx", "_my")


def inside_outline(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd test; points on a side count as inside."""
    crossings = F.aggregate(
        edges,
        F.lit(0),
        lambda acc, e: acc
        + F.when(
            ((e["y1"] > y) != (e["y2"] > y))
            & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]),
            1,
        ).otherwise(0),
    )
    on_side = F.exists(
        edges,
        lambda e: ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"]))
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])),
    )
    return (crossings % 2 == 1) | on_side


def contains(x: Column, y: Column, at: str | Callable[[str], Column] = "") -> Column:
    """Whether a measured region holds the point; its borders belong to it.

    ``at`` prefixes the region's columns, for rows that hold two regions, or
    gives the column of a name, for regions in an array. The bounding box is
    tested first, so the shape test runs on near points only.
    """
    col = at if callable(at) else lambda name: F.col(at + name)
    cx, cy, a, b, angle = (col(c) for c in ("cx", "cy", "a", "b", "angle"))
    # The box of a hexagon or ellipse is computed with roundings of its own.
    slack = 1e-9
    near = x.between(col("x0") - slack, col("x1") + slack) & y.between(col("y0") - slack, col("y1") + slack)
    dx, dy = x - cx, y - cy
    along = dx * F.cos(angle) + dy * F.sin(angle)
    across = dy * F.cos(angle) - dx * F.sin(angle)
    kind = col("kind")
    shape = (
        F.when(kind == "rectangle", x.between(cx, cx + a) & y.between(cy, cy + b))
        .when(kind == "circle", dx * dx + dy * dy <= a * a)
        .when(kind == "ellipse", F.pow(F.try_divide(along, a), 2) + F.pow(F.try_divide(across, b), 2) <= 1)
        .otherwise(inside_outline(col("edges"), x, y))
    )
    return F.coalesce(F.when(near, shape), F.lit(False))


def outline_distance(edges: Column, x: Column, y: Column) -> Column:
    """Distance to the nearest side, inside as well as outside."""

    def to_side(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        along = F.coalesce(
            F.try_divide((x - e["x1"]) * dx + (y - e["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0)
        )
        along = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
        return F.hypot(x - (e["x1"] + along * dx), y - (e["y1"] + along * dy))

    return F.array_min(F.transform(edges, to_side))


def distance(x: Column, y: Column) -> Column:
    """Distance of a point to a measured region.

    Polygon and circle give the distance to their outline even from inside,
    rectangle and hexagon are 0 inside, an ellipse counts to its centre.
    """
    cx, cy, a, b = (F.col(c) for c in ("cx", "cy", "a", "b"))
    zero = F.lit(0.0)
    dx = F.greatest(zero, cx - x, x - (cx + a))
    dy = F.greatest(zero, cy - y, y - (cy + b))
    within = contains(x, y)
    return _by_kind(
        polygon=outline_distance(F.col("edges"), x, y),
        circle=F.abs(F.hypot(x - cx, y - cy) - a),
        rectangle=F.when(within, zero).otherwise(F.sqrt(dx * dx + dy * dy)),
        hexagon=F.when(within, zero).otherwise(outline_distance(F.col("edges"), x, y)),
        ellipse=F.when(within, zero).otherwise(F.hypot(x - cx, y - cy)),
    )


#: Directions, beside those of the axes, along which shapes are told apart.
DIRECTIONS = tuple(math.pi * k / 8 for k in (1, 2, 3, 5, 6, 7))


def reach(direction: float) -> tuple[Column, Column]:
    """Least and greatest place of a measured region along a direction."""
    dx, dy = math.cos(direction), math.sin(direction)
    middle = f"(cx * {dx!r}D + cy * {dy!r}D)"
    half = f"sqrt(power(a * (cos(angle) * {dx!r}D + sin(angle) * {dy!r}D), 2) + power(b * (cos(angle) * {dy!r}D - sin(angle) * {dx!r}D), 2))"
    places = f"transform(edges, e -> e.x1 * {dx!r}D + e.y1 * {dy!r}D)"
    low, high = (
        F.expr(f"""CASE kind WHEN 'circle' THEN {middle} {sign} a WHEN 'ellipse' THEN {middle} {sign} {half}
          WHEN 'rectangle' THEN {middle} + {pick}(0D, a * {dx!r}D) + {pick}(0D, b * {dy!r}D) ELSE {end}({places}) END""")
        for sign, pick, end in (("-", "least", "array_min"), ("+", "greatest", "array_max"))
    )
    return low, high
