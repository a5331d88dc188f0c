"""Angles, quaternions and camera geometry as column expressions. Quaternions are (x, y, z, w) unless said otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Quat = tuple[Column, Column, Column, Column]


def wrap_angle(a: Column) -> Column:
    """To [-pi, pi)."""
    return F.pmod(a + math.pi, F.lit(2 * math.pi)) - math.pi


def quat_matrix(q: Quat) -> list[list[Column]]:
    """Rotation matrix of a unit quaternion."""
    x, y, z, w = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def quat_yaw(q: Quat) -> Column:
    """Heading of a quaternion."""
    x, y, z, w = q
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def quat_mul(a: Quat, b: Quat) -> Quat:
    """Hamilton product."""
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return (aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz)


def ned_to_enu(q: Quat) -> Quat:
    """Attitude of a forward-right-down body in north-east-down to a forward-left-up body in east-north-up."""
    h = math.sqrt(0.5)
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    return quat_mul(quat_mul(lit(h, h, 0, 0), q), lit(1, 0, 0, 0))


def enu_heading(q: Quat) -> Column:
    """Compass heading (clockwise from north) of an east-north-up attitude."""
    r = quat_matrix(q)
    return F.atan2(r[0][0], r[1][0])


def gravity_tilt(gx: Column, gy: Column, gz: Column) -> tuple[Column, Column]:
    """(roll, pitch) of a gravity vector in camera axes; null if the vector is shorter than 1e-6."""
    norm = F.sqrt(gx * gx + gy * gy + gz * gz)
    ok = norm > 1e-6
    return F.when(ok, F.atan2(gy, gz)), F.when(ok, F.atan2(-gx, F.sqrt(gy * gy + gz * gz)))


def camera_tilt(q: Quat) -> tuple[Column, Column]:
    """(roll, pitch) of a downward camera from its attitude in the world: where gravity lies in its axes."""
    down = [-c for c in quat_matrix(q)[2]]
    return F.atan2(down[1], down[2]), -F.asin(F.least(F.greatest(down[0], F.lit(-1.0)), F.lit(1.0)))


def level_axes(q: Quat) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """A camera's image axes with tilt taken out, as unit vectors of the horizontal plane: to the right, and down the image.

    The right one is the camera's own laid flat; if that stands upright, it is the one square to the image's other axis.
    """
    r = quat_matrix(q)
    n, m = F.hypot(r[0][0], r[1][0]), F.greatest(F.hypot(r[0][1], r[1][1]), F.lit(1e-9))
    x = F.when(n < 1e-6, -r[1][1] / m).otherwise(r[0][0] / n)
    y = F.when(n < 1e-6, r[0][1] / m).otherwise(r[1][0] / n)
    return (x, y), (y, -x)


def mat_vec(m: list[list[float]], v: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """A fixed matrix times a vector."""
    return tuple(sum((F.lit(float(k)) * c for k, c in zip(row[1:], v[1:])), F.lit(float(row[0])) * v[0]) for row in m)


def rotate(dx: Column, dy: Column, angle: Column) -> tuple[Column, Column]:
    """A plane vector turned counter-clockwise."""
    return dx * F.cos(angle) - dy * F.sin(angle), dx * F.sin(angle) + dy * F.cos(angle)


def compass_yaw(heading: Column, a: float, b_deg: float) -> Column:
    """Map yaw predicted from a compass heading."""
    return wrap_angle(F.lit(a) * heading + math.radians(b_deg))


def yaw_heading(yaw: Column, a: float, b_deg: float) -> Column:
    """The inverse as an east-north heading; the yaw itself where the scale is all but zero."""
    return yaw if abs(a) < 1e-6 else wrap_angle(F.lit(math.pi / 2) - (yaw - math.radians(b_deg)) / a)


def ground_ray(u: Column, v: Column, fx: float, fy: float, cx: float, cy: float, roll: Column, pitch: Column, altitude: Column) -> tuple[Column, Column]:
    """Where the ray of a pixel of a tilted downward camera meets the ground: (right, down) metres from nadir."""
    x, y = (u - cx) / fx, (v - cy) / fy
    # rays turned by roll about the image's vertical and pitch about its horizontal axis
    x1, z1 = x * F.cos(roll) + F.sin(roll), F.cos(roll) - x * F.sin(roll)
    y1, z2 = y * F.cos(pitch) + z1 * F.sin(pitch), z1 * F.cos(pitch) - y * F.sin(pitch)
    steep = F.when(F.abs(z2) < 1e-6, F.lit(1e-6)).otherwise(z2)
    return x1 / steep * altitude, y1 / steep * altitude
