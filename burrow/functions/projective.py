"""Planar projections. A homography is an array of nine doubles, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALLEST_SCALE = 1e-10
SMALLEST_DETERMINANT = 1e-10


def project(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Homography of a point; NULL when a coordinate is missing or the scale vanishes."""
    scale = h[6] * x + h[7] * y + h[8]
    usable = F.abs(scale) > SMALLEST_SCALE
    px = F.when(usable, (h[0] * x + h[1] * y + h[2]) / scale)
    py = F.when(usable, (h[3] * x + h[4] * y + h[5]) / scale)
    return px, py


def project_affine(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """2×3 affine matrix (six doubles) applied to a point."""
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def _minor(h: Column, a: int, b: int, c: int, d: int) -> Column:
    return h[a] * h[d] - h[b] * h[c]


def determinant(h: Column) -> Column:
    return h[0] * _minor(h, 4, 5, 7, 8) - h[1] * _minor(h, 3, 5, 6, 8) + h[2] * _minor(h, 3, 4, 6, 7)


def inverse(h: Column) -> Column:
    """Inverse homography by cofactors; NULL when the matrix is singular."""
    cofactors = [
        _minor(h, 4, 5, 7, 8), -_minor(h, 1, 2, 7, 8), _minor(h, 1, 2, 4, 5),
        -_minor(h, 3, 5, 6, 8), _minor(h, 0, 2, 6, 8), -_minor(h, 0, 2, 3, 5),
        _minor(h, 3, 4, 6, 7), -_minor(h, 0, 1, 6, 7), _minor(h, 0, 1, 3, 4),
    ]
    det = determinant(h)
    return F.when(F.abs(det) >= SMALLEST_DETERMINANT, F.array(*[c / det for c in cofactors]))


def is_usable(h: Column) -> Column:
    """Nine finite numbers with a determinant that is not zero."""
    finite = F.forall(
        h, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    )
    nine = F.coalesce(F.size(h) == 9, F.lit(False))
    # The determinant is only looked at once the shape is known to be right.
    return F.when(nine & finite, F.abs(determinant(h)) >= SMALLEST_DETERMINANT).otherwise(F.lit(False))
