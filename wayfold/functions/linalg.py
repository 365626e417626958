"""Vectors, quaternions and 3x3 matrices (row-major arrays) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAVITY = 9.80665


def at(v: Column, i: int) -> Column:
    return F.get(v, F.lit(i))


def quat_matrix(x: Column, y: Column, z: Column, w: Column) -> Column:
    """Rotation matrix of a unit quaternion."""
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    )


def quat_w(x: Column, y: Column, z: Column) -> Column:
    """The fourth component of a rotation vector that comes with three."""
    return F.sqrt(F.greatest(F.lit(0.0), 1 - x * x - y * y - z * z))


def mat_vec(m: Column, v: Column) -> Column:
    return F.array(*(sum((at(m, 3 * r + c) * at(v, c) for c in range(1, 3)), at(m, 3 * r) * at(v, 0)) for r in range(3)))


def transpose(m: Column) -> Column:
    return F.array(*(at(m, 3 * c + r) for r in range(3) for c in range(3)))


def mat_t_vec(m: Column, v: Column) -> Column:
    return mat_vec(transpose(m), v)


def mat_mat(a: Column, b: Column) -> Column:
    return F.array(*(sum((at(a, 3 * r + k) * at(b, 3 * k + c) for k in range(1, 3)), at(a, 3 * r) * at(b, c)) for r in range(3) for c in range(3)))


def dot(a: Column, b: Column) -> Column:
    return at(a, 0) * at(b, 0) + at(a, 1) * at(b, 1) + at(a, 2) * at(b, 2)


def cross(a: Column, b: Column) -> Column:
    return F.array(*(at(a, i) * at(b, j) - at(a, j) * at(b, i) for i, j in ((1, 2), (2, 0), (0, 1))))


def norm3(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def skew(v: Column) -> Column:
    o = F.lit(0.0)
    return F.array(o, -at(v, 2), at(v, 1), at(v, 2), o, -at(v, 0), -at(v, 1), at(v, 0), o)


def so3_exp(v: Column) -> Column:
    """Rotation by a rotation vector; first order below 1e-7."""
    angle, k = norm3(v), skew(v)
    near = angle < 1e-7
    a = F.when(near, F.lit(1.0)).otherwise(F.try_divide(F.sin(angle), angle))
    b = F.when(near, F.lit(0.0)).otherwise(F.try_divide(1 - F.cos(angle), angle * angle))
    square = mat_mat(k, k)
    return F.array(*(F.lit(float(i % 4 == 0)) + a * at(k, i) + b * at(square, i) for i in range(9)))


def orthonormal(m: Column) -> Column:
    """Rows of a matrix made orthonormal in order (Gram-Schmidt)."""
    row = lambda i: F.array(*(at(m, 3 * i + c) for c in range(3)))
    unit = lambda v: F.transform(v, lambda x: F.try_divide(x, norm3(v)))
    less = lambda v, u: F.zip_with(v, u, lambda x, y: x - y * dot(v, u))
    first = unit(row(0))
    second = unit(less(row(1), first))
    return F.concat(first, second, cross(first, second))


def yaw_deg(m: Column) -> Column:
    """Compass yaw, 0 to 360."""
    return (F.degrees(F.atan2(at(m, 1), at(m, 4))) + 360) % 360


def pitch_deg(m: Column) -> Column:
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), at(m, 7)))))


def roll_deg(m: Column) -> Column:
    return F.degrees(F.atan2(-at(m, 6), at(m, 8)))


def gravity_phone(m: Column) -> Column:
    """Gravity in the phone's frame: the third row, downwards."""
    return F.array(*(-GRAVITY * at(m, 6 + i) for i in range(3)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def clamp_length(v: Column, most: float) -> Column:
    """The vector, shortened to ``most`` where it is longer."""
    return F.when(norm3(v) > most, F.transform(v, lambda x: F.try_divide(x * most, norm3(v)))).otherwise(v)


def magnetic_heading(g: Column, m: Column) -> Column:
    """Mathematical heading of phone-Y from East, tilt-compensated; NaN if degenerate.

    East is field x gravity, North is gravity x East.
    """
    east = cross(m, g)
    size, down = norm3(east), norm3(g)
    unit_e = F.transform(east, lambda x: F.try_divide(x, size))
    unit_g = F.transform(g, lambda x: F.try_divide(x, down))
    north = cross(unit_g, unit_e)
    return F.when((size < 1e-6) | (down < 1e-6), F.lit(float("nan"))).otherwise(F.atan2(at(north, 1), at(unit_e, 1)))


def complementary(mag: Column, gyro: Column, share: float = 0.02) -> Column:
    """Blend of a magnetic and a gyro heading, wrapped after blending."""
    turn = 6.283185307179586
    wrap = lambda x: F.when(x < 0, x % turn).otherwise(x)
    mixed = share * wrap(mag) + (1 - share) * wrap(gyro)
    return F.when(mixed > turn / 2, mixed % (turn / 2) - turn / 2).otherwise(mixed)
