"""Vectors and quaternions as plain column arithmetic (no Python at run time).

A vector is a 3-tuple of columns (x, y, z); a quaternion a 4-tuple (w, x, y, z)
that turns body coordinates into world coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: standard gravity, and its direction in the world frame
G = 9.80665
GRAVITY = (0.0, 0.0, -9.80665)

Vec = tuple[Column, Column, Column]
Quat = tuple[Column, Column, Column, Column]


def cols(*names: str) -> tuple[Column, ...]:
    return tuple(F.col(n) for n in names)


def lit3(v) -> Vec:
    return tuple(F.lit(float(x)) for x in v)


def norm(v) -> Column:
    total = v[0] * v[0]
    for c in v[1:]:
        total = total + c * c
    return F.sqrt(total)


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b))


def scale(a: Vec, s) -> Vec:
    return tuple(x * s for x in a)


def dot(a, b) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        total = total + x * y
    return total


def cross(a: Vec, b: Vec) -> Vec:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def unit(q: Quat) -> Quat:
    size = norm(q)
    return tuple(c / size for c in q)


def inverse(q: Quat) -> Quat:
    """Inverse of a unit quaternion."""
    return (q[0], -q[1], -q[2], -q[3])


def multiply(a: Quat, b: Quat) -> Quat:
    aw, av, bw, bv = a[0], a[1:], b[0], b[1:]
    c = cross(av, bv)
    return (aw * bw - dot(av, bv), *(aw * y + bw * x + z for x, y, z in zip(av, bv, c)))


def rotate(q: Quat, v: Vec) -> Vec:
    """v + 2 w (u x v) + 2 u x (u x v) for a unit quaternion (w, u)."""
    u = q[1:]
    first = scale(cross(u, v), 2.0)
    second = cross(u, first)
    return tuple(x + q[0] * a + b for x, a, b in zip(v, first, second))


def exponential(rotvec: Vec) -> Quat:
    """Rotation vector to unit quaternion, series below 1e-8 rad."""
    theta = norm(rotvec)
    half = theta / 2.0
    factor = F.when(theta < 1e-8, F.lit(0.5) - theta * theta / 48.0).otherwise(F.sin(half) / theta)
    return (F.cos(half), *scale(rotvec, factor))


def logarithm(q: Quat) -> Vec:
    """Unit quaternion to the rotation vector of smallest angle."""
    flip = F.when(q[0] < 0, -1.0).otherwise(1.0)
    size = norm(q[1:])
    angle = 2.0 * F.atan2(size, q[0] * flip)
    factor = F.when(size < 1e-12, F.lit(2.0)).otherwise(angle / size)
    return tuple(c * flip * factor for c in q[1:])


def rotation_angle(q: Quat) -> Column:
    """Angle in radians of a unit quaternion's rotation, in [0, pi]."""
    return 2.0 * F.atan2(norm(q[1:]), F.abs(q[0]))


def wrap_angle(a: Column) -> Column:
    return F.atan2(F.sin(a), F.cos(a))


def circular_spread_180(angle_deg: Column) -> Column:
    """Aggregate: spread in degrees of axis directions (angles modulo 180)."""
    doubled = F.radians(angle_deg) * 2.0
    c, s = F.avg(F.cos(doubled)), F.avg(F.sin(doubled))
    r = F.greatest(F.sqrt(c * c + s * s), F.lit(1e-12))
    return F.degrees(F.sqrt(F.greatest(-2.0 * F.log(r), F.lit(0.0)))) / 2.0
