"""Plane geometry as column expressions: homographies, boxes, lens angles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A homogeneous weight of at most this size has no image.
MIN_WEIGHT = 1e-6


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def apply_homography(h: list, x: Column, y: Column) -> tuple[Column, Column]:
    """Image of (x, y) under nine row-major entries (columns or numbers); null where the weight vanishes."""
    h = [v if isinstance(v, Column) else F.lit(float(v)) for v in h]
    w = h[6] * x + h[7] * y + h[8]
    ok = F.abs(w) > MIN_WEIGHT
    return F.when(ok, (h[0] * x + h[1] * y + h[2]) / w), F.when(ok, (h[3] * x + h[4] * y + h[5]) / w)


def invert_homography(h: list) -> list[Column]:
    """The nine entries of the inverse matrix; null where it is singular."""
    a, b, c, d, e, f, g, i, j = (v if isinstance(v, Column) else F.lit(float(v)) for v in h)
    minors = [e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d]
    det = a * minors[0] + b * minors[3] + c * minors[6]
    return [F.when(F.abs(det) > 0, m / det) for m in minors]


def box_overlap(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes, each as left, top, right, bottom; 0 where neither has an area."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = wide * high
    area = lambda q: (q[2] - q[0]) * (q[3] - q[1])
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def focal_pixels(fov_degrees: float, width: float) -> float:
    """Focal length in pixels of a horizontal field of view."""
    return width / (2.0 * math.tan(math.radians(fov_degrees) / 2.0))


def field_of_view(focal: float, width: float) -> float:
    """Horizontal field of view in degrees of a focal length in pixels."""
    return math.degrees(2.0 * math.atan(width / (2.0 * focal)))


def angle_between(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between two vectors; 0 where one has no length."""
    la, lb = hypot(ax, ay), hypot(bx, by)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / (la * lb)))
    return F.when((la < 1e-6) | (lb < 1e-6), F.lit(0.0)).otherwise(F.degrees(F.acos(cosine)))


def focal_of(fov_degrees: Column, width: float) -> Column:
    """focal_pixels() of a column."""
    return F.lit(width) / (2.0 * F.tan(F.radians(fov_degrees) / 2.0))


def fov_of(focal: Column, width: float) -> Column:
    """field_of_view() of a column."""
    return F.degrees(2.0 * F.atan(F.lit(width) / (2.0 * focal)))


def meeting_point(a: list[Column], b: list[Column]) -> tuple[Column, Column]:
    """Where the lines through two points each (x1, y1, x2, y2) meet; null where they are parallel."""
    across = (a[0] - a[2]) * (b[1] - b[3]) - (a[1] - a[3]) * (b[0] - b[2])
    t = ((a[0] - b[0]) * (b[1] - b[3]) - (a[1] - b[1]) * (b[0] - b[2])) / across
    ok = F.abs(across) >= 1e-10
    return F.when(ok, a[0] + t * (a[2] - a[0])), F.when(ok, a[1] + t * (a[3] - a[1]))


def orientation(angle: Column) -> Column:
    """horizontal, vertical or diagonal, of an angle in degrees."""
    low = F.when(F.abs(angle) > 90, 180 - F.abs(angle)).otherwise(F.abs(angle))
    return F.when(low < 20, "horizontal").when(low > 70, "vertical").otherwise("diagonal")


def rotation(pan: Column, tilt: Column, roll: Column) -> list[Column]:
    """Nine row-major entries of the rotation by pan about z, tilt about x, and roll about z, in radians."""
    cp, sp, ct, st, cr, sr = F.cos(pan), F.sin(pan), F.cos(tilt), F.sin(tilt), F.cos(roll), F.sin(roll)
    return [cp * cr - sp * ct * sr, -cp * sr - sp * ct * cr, sp * st, sp * cr + cp * ct * sr, -sp * sr + cp * ct * cr, -cp * st, st * sr, st * cr, ct]


def pan_tilt_roll(r: list[Column]) -> tuple[Column, Column, Column]:
    """Angles of a rotation, tilt from 0 to pi; without a tilt the roll counts as pan."""
    tilt = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r[8])))
    level = F.abs(F.sin(tilt)) < 1e-6
    return F.when(level, F.atan2(r[3], r[0])).otherwise(F.atan2(r[2], -r[5])), tilt, F.when(level, F.lit(0.0)).otherwise(F.atan2(r[6], r[7]))


def anchor_quality(overlap: Column, keypoints: Column, error: Column, confidence: Column, lines: Column) -> Column:
    """How good a frame is to calibrate from: five parts from 0 to 1, weighted; an unknown error counts as the worst."""
    worth = F.when(error.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - error / 20.0))
    return 0.30 * overlap + 0.25 * F.least(F.lit(1.0), keypoints / 12.0) + 0.20 * worth + 0.15 * confidence + 0.10 * F.least(F.lit(1.0), lines / 6.0)
