"""Rotations as column expressions: quaternions (w, x, y, z), flat 3x3 matrices
(row by row), axis-angle vectors and the first two rows of a matrix (6-D)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)


def _parts(v: Column, n: int) -> list[Column]:
    return [F.get(v, i) for i in range(n)]


def _unit(v: list[Column]) -> list[Column]:
    size = F.sqrt(sum((x * x for x in v[1:]), v[0] * v[0]))
    return [F.try_divide(x, size) for x in v]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def quaternion_to_matrix(q: Column) -> Column:
    return _let(q, lambda p: _let(F.array(*_unit(_parts(p, 4))), _to_matrix))


def _to_matrix(q: Column) -> Column:
    w, x, y, z = _parts(q, 4)
    return F.array(1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y))


def matrix_to_quaternion(m: Column) -> Column:
    """The quaternion with a positive real part; the largest part is the divisor."""
    return _let(m, lambda v: _let(_doubled(v), lambda d: standardize(_divided(v, d))))


def _doubled(m: Column) -> Column:
    """Twice the absolute parts of the quaternion, from the diagonal."""
    a = _parts(m, 9)
    part = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    return F.array(part(1 + a[0] + a[4] + a[8]), part(1 + a[0] - a[4] - a[8]), part(1 - a[0] + a[4] - a[8]), part(1 - a[0] - a[4] + a[8]))


def _divided(m: Column, doubled: Column) -> Column:
    a, d = _parts(m, 9), _parts(doubled, 4)
    rows = [
        [d[0] * d[0], a[7] - a[5], a[2] - a[6], a[3] - a[1]],
        [a[7] - a[5], d[1] * d[1], a[3] + a[1], a[2] + a[6]],
        [a[2] - a[6], a[3] + a[1], d[2] * d[2], a[5] + a[7]],
        [a[3] - a[1], a[6] + a[2], a[7] + a[5], d[3] * d[3]],
    ]
    made = [F.array(*[F.try_divide(x, 2 * d[i]) for x in row]) for i, row in enumerate(rows)]
    top = F.greatest(*d)
    return F.when(d[0] == top, made[0]).when(d[1] == top, made[1]).when(d[2] == top, made[2]).otherwise(made[3])


def standardize(q: Column) -> Column:
    return _let(q, lambda v: F.when(F.get(v, 0) < 0, F.transform(v, lambda x: -x)).otherwise(v))


def multiply(a: Column, b: Column) -> Column:
    return _let(a, lambda p: _let(b, lambda q: _product(p, q)))


def _product(a: Column, b: Column) -> Column:
    w1, x1, y1, z1 = _parts(a, 4)
    w2, x2, y2, z2 = _parts(b, 4)
    return F.array(w1 * w2 - x1 * x2 - y1 * y2 - z1 * z2, w1 * x2 + x1 * w2 + y1 * z2 - z1 * y2, w1 * y2 - x1 * z2 + y1 * w2 + z1 * x2, w1 * z2 + x1 * y2 - y1 * x2 + z1 * w2)


def invert(q: Column) -> Column:
    return F.transform(q, lambda x, i: F.when(i == 0, x).otherwise(-x))


def apply(q: Column, point: Column) -> Column:
    p = F.concat(F.array(F.lit(0.0)), point)
    return _let(q, lambda r: F.slice(multiply(multiply(r, p), invert(r)), 2, 3))


def axis_angle_to_quaternion(v: Column) -> Column:
    """With the series of sin(a / 2) / a for small angles."""

    def made(u: Column, angle: Column) -> Column:
        k = F.when(angle < 1e-6, 0.5 - angle * angle / 48).otherwise(F.try_divide(F.sin(angle / 2), angle))
        return F.concat(F.array(F.cos(angle / 2)), _let(k, lambda s: F.transform(u, lambda x: x * s)))

    return _let(v, lambda u: _let(F.sqrt(_dot(_parts(u, 3), _parts(u, 3))), lambda angle: made(u, angle)))


def quaternion_to_axis_angle(q: Column) -> Column:

    def made(u: Column, angle: Column) -> Column:
        k = F.when(F.abs(angle) < 1e-6, 0.5 - angle * angle / 48).otherwise(F.try_divide(F.sin(angle / 2), angle))
        return _let(k, lambda s: F.transform(F.slice(u, 2, 3), lambda x: F.try_divide(x, s)))

    def of(u: Column) -> Column:
        w, *v = _parts(u, 4)
        return _let(2 * F.atan2(F.sqrt(_dot(v, v)), w), lambda angle: made(u, angle))

    return _let(q, of)


def axis_angle_to_matrix(v: Column) -> Column:
    return quaternion_to_matrix(axis_angle_to_quaternion(v))


def matrix_to_axis_angle(m: Column) -> Column:
    return quaternion_to_axis_angle(matrix_to_quaternion(m))


def sixd_to_matrix(d: Column) -> Column:
    """Gram-Schmidt on two rows; the third is their cross product."""

    def second(a: Column, x: Column) -> Column:
        u, v = _parts(a, 3), _parts(x, 6)[3:]
        rest = _let(_dot(u, v), lambda k: F.array(*[q - k * p for p, q in zip(u, v, strict=True)]))
        return _let(rest, lambda r: F.array(*_unit(_parts(r, 3))))

    def rows(a: Column, b: Column) -> Column:
        return F.concat(a, b, F.array(*_cross(_parts(a, 3), _parts(b, 3))))

    return _let(d, lambda x: _let(F.array(*_unit(_parts(x, 6)[:3])), lambda a: _let(second(a, x), lambda b: rows(a, b))))


def matrix_to_sixd(m: Column) -> Column:
    return F.slice(m, 1, 6)


def euler_to_matrix(angles: Column, order: str = "XYZ") -> Column:
    """The product of three axis rotations, in any of the twelve orders."""
    out = None
    for i, axis in enumerate(order):
        c, s, one, zero = F.cos(F.get(angles, i)), F.sin(F.get(angles, i)), F.lit(1.0), F.lit(0.0)
        m = {"X": [one, zero, zero, zero, c, -s, zero, s, c], "Y": [c, zero, s, zero, one, zero, -s, zero, c], "Z": [c, -s, zero, s, c, zero, zero, zero, one]}[axis]
        out = m if out is None else [out[3 * r] * m[k] + out[3 * r + 1] * m[3 + k] + out[3 * r + 2] * m[6 + k] for r in range(3) for k in range(3)]
    return F.array(*out)


def slerp(a: Column, b: Column, t: float) -> Column:
    """Spherical interpolation along the shorter way."""

    def blend(p: Column, q: Column, d: Column) -> Column:
        return _let(F.acos(F.least(F.abs(d), F.lit(1.0))), lambda g: weighted(p, q, d, g))

    def weighted(p: Column, q: Column, d: Column, g: Column) -> Column:
        near = F.sin(g) < 1e-6
        u = F.when(near, 1 - t).otherwise(F.try_divide(F.sin((1 - t) * g), F.sin(g)))
        v = F.when(near, t).otherwise(F.try_divide(F.sin(t * g), F.sin(g))) * F.when(d < 0, -1.0).otherwise(1.0)
        return _let(F.array(u, v), lambda w: F.zip_with(p, q, lambda x, y: F.get(w, 0) * x + F.get(w, 1) * y))

    return _let(a, lambda p: _let(b, lambda q: _let(_dot(_parts(p, 4), _parts(q, 4)), lambda d: blend(p, q, d))))


def matrix_to_euler(m: Column, order: str = "XYZ") -> Column:
    """The angles of three axis rotations in any of the twelve orders, whose product is the matrix.

    The middle angle lies in [-pi/2, pi/2] for three different axes, in [0, pi] for two.
    """
    i, j, k = ("XYZ".index(a) for a in order)
    proper = i == k

    def made(v: Column) -> Column:
        a = lambda r, c: F.get(v, 3 * r + c)
        clip = lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0))
        if proper:
            other = 3 - i - j
            sign = 1 if (j - i) % 3 == 1 else -1  # whether i, j, other turn like X, Y, Z
            return F.array(F.atan2(a(j, i), -sign * a(other, i)), F.acos(clip(a(i, i))), F.atan2(a(i, j), sign * a(i, other)))
        sign = 1 if (j - i) % 3 == 1 else -1
        return F.array(F.atan2(-sign * a(j, k), a(k, k)), F.asin(clip(sign * a(i, k))), F.atan2(-sign * a(i, j), a(i, i)))

    return _let(m, made)


def normalize(q: Column) -> Column:
    return _let(q, lambda p: F.array(*_unit(_parts(p, 4))))


def power(q: Column, t: float | Column) -> Column:
    """The rotation by t times the angle of a quaternion, about its axis."""

    def made(p: Column, angle: Column) -> Column:
        turned = t * angle
        return F.concat(F.array(F.cos(turned)), F.transform(F.slice(p, 2, 3), lambda x: x / F.sin(angle) * F.sin(turned)))

    clip = lambda w: F.greatest(F.least(w, F.lit(1.0)), F.lit(-1.0))
    return _let(normalize(q), lambda p: _let(F.greatest(F.acos(clip(F.get(p, 0))), F.lit(1e-9)), lambda angle: made(p, angle)))


def between(a: Column, b: Column) -> Column:
    """The quaternion that turns one vector to the direction of another."""

    def made(p: Column, q: Column) -> Column:
        u, v = _parts(p, 3), _parts(q, 3)
        return normalize(F.array(F.sqrt(_dot(u, u) * _dot(v, v)) + _dot(u, v), *_cross(u, v)))

    return _let(a, lambda p: _let(b, lambda q: made(p, q)))


def twist(q: Column, axis: tuple[float, float, float]) -> Column:
    """The part of a rotation about a unit axis: of all turns about it, the nearest to q.

    Half a turn about an axis across it has none; its twist is then half a turn about the
    axis, backwards.
    """

    def made(p: Column) -> Column:
        w, *v = _parts(p, 4)
        along = _dot(v, [F.lit(float(a)) for a in axis])
        return _let(F.array(w, along), lambda t: _let(F.sqrt(F.get(t, 0) * F.get(t, 0) + F.get(t, 1) * F.get(t, 1)), lambda n: F.when(n > 0, F.array(F.get(t, 0) / n, *[F.get(t, 1) / n * float(a) for a in axis])).otherwise(F.array(F.lit(0.0), *[F.lit(-float(a)) for a in axis]))))

    return _let(q, made)


def swing(q: Column, axis: tuple[float, float, float]) -> Column:
    """What a rotation does after its twist about the axis: q is swing times twist."""
    return _let(q, lambda p: multiply(p, invert(twist(p, axis))))


def lerp(a: Column, b: Column, t: float | Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + t * (y - x))


def log(q: Column) -> Column:
    """Half the axis-angle vector of a unit quaternion."""

    def made(p: Column) -> Column:
        w, *v = _parts(p, 4)
        return _let(F.sqrt(_dot(v, v)), lambda n: F.transform(F.slice(p, 2, 3), lambda x: F.when(n == 0, 0.0).otherwise(F.try_divide(x, n) * F.atan2(n, w))))

    return _let(q, made)


def exp(v: Column) -> Column:
    """The unit quaternion of half an axis-angle vector."""
    return _let(v, lambda u: _let(F.sqrt(_dot(_parts(u, 3), _parts(u, 3))), lambda n: F.concat(F.array(F.cos(n)), F.transform(u, lambda x: F.when(n == 0, 0.0).otherwise(x * F.try_divide(F.sin(n), n))))))


def angular_velocity(m: Column, rate: Column) -> Column:
    """The angular velocity of a rotation (flat matrix) from the matrix's derivative."""
    w = lambda r, c: sum((F.get(rate, 3 * r + k) * F.get(m, 3 * c + k) for k in (1, 2)), F.get(rate, 3 * r) * F.get(m, 3 * c))
    return F.array((w(2, 1) - w(1, 2)) / 2, (w(0, 2) - w(2, 0)) / 2, (w(1, 0) - w(0, 1)) / 2)


def to_homogeneous(point: Column) -> Column:
    return F.concat(point, F.array(F.lit(1.0)))


def from_homogeneous(point: Column) -> Column:
    """Without the last component, divided by it unless it is 0."""
    last = F.element_at(point, -1)
    return F.transform(F.slice(point, 1, F.size(point) - 1), lambda x: F.when(last == 0, x).otherwise(F.try_divide(x, last)))
