"""The full camera model as column expressions: rotation vectors, lens distortion, rays, look-at angles.

Vectors and matrices are Python lists of columns or numbers; a rotation has nine entries, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import apply_homography, invert_homography

#: Rounds of the fixed-point search that takes out lens distortion; a point must be this far before the camera to be seen.
UNDISTORT_ROUNDS, MIN_DEPTH = 5, 0.1


def _dot(a: list, b: list):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: list, b: list) -> list:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def rotation_of_vector(v: list) -> list:
    """The rotation about v by its length in radians."""
    angle = F.sqrt(_dot(v, v))
    still = angle < 1e-12
    k = [F.when(still, F.lit(0.0)).otherwise(c / angle) for c in v]
    c, s = F.cos(angle), F.sin(angle)
    turn = [[F.lit(0.0), -k[2], k[1]], [k[2], F.lit(0.0), -k[0]], [-k[1], k[0], F.lit(0.0)]]
    return [(c if i == j else F.lit(0.0)) + (1 - c) * k[i] * k[j] + s * turn[i][j] for i in range(3) for j in range(3)]


def projected(point: list, r: list, t: list, k: tuple, lens: tuple = (0.0,) * 5) -> tuple[Column, Column, Column]:
    """Pixel of a world point, and whether it lies before the camera. k: focal lengths and centre; lens: k1, k2, p1, p2, k3."""
    x, y, z = (_dot(r[3 * i : 3 * i + 3], point) + t[i] for i in range(3))
    a, b = x / z, y / z
    r2 = a * a + b * b
    k1, k2, p1, p2, k3 = lens
    out = 1 + ((k3 * r2 + k2) * r2 + k1) * r2
    u, v = a * out + 2 * p1 * a * b + p2 * (r2 + 2 * a * a), b * out + p1 * (r2 + 2 * b * b) + 2 * p2 * a * b
    return k[0] * u + k[2], k[1] * v + k[3], z > MIN_DEPTH


def undistorted(u: Column, v: Column, k: tuple, lens: tuple = (0.0,) * 5) -> Column:
    """A struct of x and y, the undistorted point at depth 1 of a pixel; the plain one where the search leaves the lens model."""
    k1, k2, p1, p2, k3 = lens
    x0, y0 = (u - k[2]) / k[0], (v - k[3]) / k[1]
    state = lambda x, y, stop: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), stop.alias("stop"))

    def step(s, _):
        x, y = s["x"], s["y"]
        r2 = x * x + y * y
        part = 1 / (1 + ((k3 * r2 + k2) * r2 + k1) * r2)
        x1, y1 = (x0 - 2 * p1 * x * y - p2 * (r2 + 2 * x * x)) * part, (y0 - p1 * (r2 + 2 * y * y) - 2 * p2 * x * y) * part
        stop = s["stop"] | (part < 0)
        return state(F.when(stop, x0).otherwise(x1), F.when(stop, y0).otherwise(y1), stop)

    return F.aggregate(F.sequence(F.lit(1), F.lit(UNDISTORT_ROUNDS)), state(x0, y0, F.lit(False)), step)


def ground_point(point: Column, r: list, t: list) -> tuple[Column, Column]:
    """Where on the ground an undistorted point lies; null where the view has no such place."""
    view = [r[0], r[1], t[0], r[3], r[4], t[1], r[6], r[7], t[2]]
    return apply_homography(invert_homography([v if isinstance(v, Column) else F.lit(float(v)) for v in view]), point["x"], point["y"])


def camera_centre(r: list, t: list) -> list:
    """The camera's place in the world."""
    return [-_dot([r[j], r[3 + j], r[6 + j]], t) for j in range(3)]


def ray(point: Column, r: list) -> list:
    """World direction, of length 1, of an undistorted point."""
    d = [r[j] * point["x"] + r[3 + j] * point["y"] + r[6 + j] for j in range(3)]
    length = F.sqrt(_dot(d, d))
    return [c / length for c in d]


def meets_plane(origin: list, direction: list, axis: int, value: float) -> list:
    """Where a ray meets the plane on which a coordinate has a value: its other two; null behind the camera or along the plane."""
    t = (value - origin[axis]) / direction[axis]
    ok = (F.abs(direction[axis]) >= 1e-8) & (t >= 0)
    return [F.when(ok, origin[i] + t * direction[i]) for i in range(3) if i != axis]


def _forward_up(yaw: Column, down: Column) -> tuple[list, list]:
    cy, sy, ce, se = F.cos(yaw), F.sin(yaw), F.cos(down), F.sin(down)
    return [ce * sy, ce * cy, -se], [se * sy, se * cy, ce]


def look_at_rotation(yaw: Column, down: Column, roll: Column) -> list:
    """World-to-camera rotation of a camera that looks along +y at yaw 0, below the horizon by down, rolled about its axis."""
    forward, up = _forward_up(yaw, down)
    side = _cross(forward, up)
    y = [-(a * F.cos(roll) + b * F.sin(roll)) for a, b in zip(up, side)]
    return [*_cross(y, forward), *y, *forward]


def look_at_angles(r: list) -> tuple[Column, Column, Column]:
    """yaw, down and roll of a rotation."""
    down = F.asin(-F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r[8])))
    yaw = F.atan2(r[6], r[7])
    forward, up = _forward_up(yaw, down)
    y = [-r[3], -r[4], -r[5]]
    return yaw, down, F.atan2(_dot(y, _cross(forward, up)), _dot(y, up))
