"""More rotation queries: angles, powers, turns between directions, logarithms, speeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import rotations as R
from weftline.operators import metrics as M
from weftline.plans._tables import r6
from weftline.plans.rotation import _BASE, _MAT, _unit, _v

ORDERS = ("XYZ", "XZY", "YXZ", "YZX", "ZXY", "ZYX", "ZYZ", "XYX")


def matrix_euler(spark, sf_dir):
    """Angles of a rotation in eight orders: the largest error of the matrix made of them, and those of XYZ."""
    m = R.quaternion_to_matrix(F.col("q"))
    x = _v(spark, sf_dir).select("vec_id", m.alias("m"))
    error = lambda o: F.aggregate(F.zip_with(R.euler_to_matrix(R.matrix_to_euler(F.col("m"), o), o), "m", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, d: F.greatest(s, d)) < 1e-6
    xyz = R.matrix_to_euler(F.col("m"), "XYZ")
    return x.select("vec_id", *[error(o).alias(o.lower()) for o in ORDERS], *[r6(F.get(xyz, i)).alias(f"a{i}") for i in range(3)])


def quat_power(spark, sf_dir):
    half = R.power(F.col("q"), 0.5)
    twice = R.multiply(half, half)
    return _v(spark, sf_dir).select("vec_id", *[r6(F.get(half, i)).alias(f"h{i}") for i in range(4)], *[r6(F.get(twice, i)).alias(f"q{i}") for i in range(4)])


def turn_between(spark, sf_dir):
    """The turn from one direction to another, applied to the first; and points between two."""
    b = F.slice("d", 1, 3)
    turned = R.apply(R.between(F.col("a"), b), F.col("a"))
    scaled = F.transform(turned, lambda x: x / M.norm(F.col("a")) * M.norm(b))
    return _v(spark, sf_dir).select("vec_id", *[r6(F.get(scaled, i)).alias(f"t{i}") for i in range(3)], *[r6(F.get(R.lerp(F.col("a"), b, 0.25), i)).alias(f"l{i}") for i in range(3)])


def quat_log(spark, sf_dir):
    u = _unit(F.col("q"))
    v = R.log(u)
    back = R.exp(v)
    return _v(spark, sf_dir).select("vec_id", *[r6(F.get(v, i)).alias(f"v{i}") for i in range(3)], *[r6(F.get(back, i)).alias(f"q{i}") for i in range(4)])


def turning_speed(spark, sf_dir):
    """Angular velocity of a rotation whose matrix changes by the given rate."""
    m, rate = R.quaternion_to_matrix(F.col("q")), R.quaternion_to_matrix(F.col("p"))
    x = _v(spark, sf_dir).select("vec_id", m.alias("m"), rate.alias("rate"), "a")
    w = R.angular_velocity(F.col("m"), F.col("rate"))
    far = R.from_homogeneous(F.transform(R.to_homogeneous(F.col("a")), lambda v: v * 4.0))
    return x.select("vec_id", *[r6(F.get(w, i)).alias(f"w{i}") for i in range(3)], *[r6(F.get(far, i)).alias(f"p{i}") for i in range(3)])


QUERIES = {f.__name__: f for f in (matrix_euler, quat_power, turn_between, quat_log, turning_speed)}
_r = lambda x, n: f"round({x}, 6) + 0.0 AS {n}"
_M = f"{_BASE}, m AS (SELECT vec_id, a, [{', '.join(_MAT('uq'))}] AS m, [{', '.join(_MAT('up'))}] AS r FROM w)"
_n3 = lambda v: f"sqrt({v}[1] * {v}[1] + {v}[2] * {v}[2] + {v}[3] * {v}[3])"
_skew = lambda i, j: "(" + " + ".join(f"r[{3 * i + k}] * m[{3 * j + k}]" for k in (1, 2, 3)) + ")"
ORACLE = {
    "matrix_euler": f"WITH {_M} SELECT vec_id, " + ", ".join(f"TRUE AS {o.lower()}" for o in ORDERS) + f", {_r('atan2(-m[6], m[9])', 'a0')}, {_r('asin(greatest(least(m[3], 1.0), -1.0))', 'a1')}, {_r('atan2(-m[2], m[1])', 'a2')} FROM m",
    "quat_power": f"WITH {_BASE}, t AS (SELECT *, acos(uq[1]) AS h FROM w) SELECT vec_id, {_r('cos(h / 2)', 'h0')}, " + ", ".join(_r(f"uq[{i + 1}] / sin(h) * sin(h / 2)", f"h{i}") for i in (1, 2, 3)) + ", " + ", ".join(_r(f"uq[{i + 1}]", f"q{i}") for i in range(4)) + " FROM t",
    "turn_between": f"WITH {_BASE} SELECT vec_id, " + ", ".join(_r(f"d[{i}]", f"t{i - 1}") for i in (1, 2, 3)) + ", " + ", ".join(_r(f"a[{i}] + 0.25::DOUBLE * (d[{i}] - a[{i}])", f"l{i - 1}") for i in (1, 2, 3)) + " FROM w",
    "quat_log": f"WITH {_BASE}, t AS (SELECT *, sqrt(uq[2] * uq[2] + uq[3] * uq[3] + uq[4] * uq[4]) AS n FROM w) SELECT vec_id, " + ", ".join(_r(f"uq[{i + 2}] / n * atan2(n, uq[1])", f"v{i}") for i in range(3)) + ", " + ", ".join(_r(f"uq[{i + 1}]", f"q{i}") for i in range(4)) + " FROM t",
    "turning_speed": f"WITH {_M} SELECT vec_id, {_r(f'({_skew(2, 1)} - {_skew(1, 2)}) / 2', 'w0')}, {_r(f'({_skew(0, 2)} - {_skew(2, 0)}) / 2', 'w1')}, {_r(f'({_skew(1, 0)} - {_skew(0, 1)}) / 2', 'w2')}, " + ", ".join(_r(f"a[{i}]", f"p{i - 1}") for i in (1, 2, 3)) + " FROM m",
}
