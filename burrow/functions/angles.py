"""Head-orientation angles as column expressions (degrees unless said otherwise)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YAW_OFFSET = -167.0
YAW_DIRECTION = -1.0


def wrap(angle: Column) -> Column:
    """Angle in [-180, 180)."""
    return F.pmod(angle + 180.0, F.lit(360.0)) - 180.0


def calibrated_yaw(yaw: Column, offset: float = YAW_OFFSET, direction: float = YAW_DIRECTION) -> Column:
    return wrap(yaw - offset) * direction


def quaternion_angles(w: Column, x: Column, y: Column, z: Column) -> dict[str, Column]:
    """yaw, pitch, roll of an extrinsic z-y-x rotation; NULL for a zero quaternion."""
    norm = F.sqrt(w * w + x * x + y * y + z * z)
    w, x, y, z = (F.try_divide(c, norm) for c in (w, x, y, z))
    sine = 2.0 * (x * z + w * y)
    return {
        "yaw": F.degrees(F.atan2(2.0 * (w * z - x * y), 1.0 - 2.0 * (y * y + z * z))),
        "pitch": F.degrees(F.asin(F.least(F.greatest(sine, F.lit(-1.0)), F.lit(1.0)))),
        "roll": F.degrees(F.atan2(2.0 * (w * x - y * z), 1.0 - 2.0 * (x * x + y * y))),
    }


def to_radians(angle: Column) -> Column:
    return F.radians(angle)


def to_degrees(angle: Column) -> Column:
    return F.degrees(angle)
