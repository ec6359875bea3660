"""Rotation queries: embeddings read as quaternions, axes and matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import rotations as R
from weftline.operators import metrics as M
from weftline.plans._tables import VECTORS, r6, vectors


def _v(spark, sf_dir):
    v = vectors(spark, sf_dir, 16)
    return v.select("vec_id", F.slice("vec", 1, 4).alias("q"), F.slice("vec", 5, 4).alias("p"), F.slice("vec", 9, 3).alias("a"), F.slice("vec", 11, 6).alias("d"))


def _unit(q):
    return F.transform(q, lambda x: x / M.norm(q))


def quat_matrix(spark, sf_dir):
    """Quaternion to matrix, and back up to sign."""
    m = R.quaternion_to_matrix(F.col("q"))
    back = R.matrix_to_quaternion(m)
    x = _v(spark, sf_dir).select("vec_id", m.alias("m"), back.alias("back"))
    return x.select("vec_id", *[r6(F.get("m", i)).alias(f"m{i}") for i in range(9)], *[r6(F.get("back", i)).alias(f"q{i}") for i in range(4)])


def quat_products(spark, sf_dir):
    x = R.multiply(F.col("q"), F.col("p"))
    y = R.apply(_unit(F.col("q")), F.col("a"))
    return _v(spark, sf_dir).select("vec_id", *[r6(F.get(x, i)).alias(f"x{i}") for i in range(4)], *[r6(F.get(y, i)).alias(f"y{i}") for i in range(3)])


def axis_angle(spark, sf_dir):
    m = R.axis_angle_to_matrix(F.col("a"))
    back = R.matrix_to_axis_angle(m)
    return _v(spark, sf_dir).select("vec_id", *[r6(F.get(m, i)).alias(f"m{i}") for i in (0, 1, 5, 8)], *[F.round(F.get(back, i), 5).alias(f"a{i}") for i in range(3)])


def rot6d_roundtrip(spark, sf_dir):
    m = R.sixd_to_matrix(F.col("d"))
    again = R.sixd_to_matrix(R.matrix_to_sixd(m))
    same = F.aggregate(F.zip_with(m, again, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: F.greatest(s, x)) < 1e-9
    return _v(spark, sf_dir).select("vec_id", *[r6(F.get(m, i)).alias(f"m{i}") for i in range(9)], same.alias("same"))


def euler_matrix(spark, sf_dir):
    m = R.euler_to_matrix(F.col("a"), "ZYX")
    return _v(spark, sf_dir).select("vec_id", *[r6(F.get(m, i)).alias(f"m{i}") for i in (0, 2, 4, 7)])


def slerp(spark, sf_dir):
    x = R.slerp(_unit(F.col("q")), _unit(F.col("p")), 0.25)
    return _v(spark, sf_dir).select("vec_id", *[r6(F.get(x, i)).alias(f"x{i}") for i in range(4)], r6(M.norm(x)).alias("size"))


def geodesic(spark, sf_dir):
    d = M.geodesic(R.quaternion_to_matrix(F.col("q")), R.quaternion_to_matrix(F.col("p")))
    return _v(spark, sf_dir).select("vec_id", r6(d).alias("angle"))


QUERIES = {f.__name__: f for f in (quat_matrix, quat_products, axis_angle, rot6d_roundtrip, euler_matrix, slerp, geodesic)}
_S = "sqrt({0}[1] * {0}[1] + {0}[2] * {0}[2] + {0}[3] * {0}[3] + {0}[4] * {0}[4])"
_BASE = f"""{VECTORS}, s AS (SELECT vec_id, vec[1:4] AS q, vec[5:8] AS p, vec[9:11] AS a, vec[11:16] AS d FROM vectors),
u AS (SELECT *, {_S.format('q')} AS nq, {_S.format('p')} AS np FROM s),
w AS (SELECT *, list_transform(q, lambda x: x / nq) AS uq, list_transform(p, lambda x: x / np) AS up FROM u)"""
_MAT = lambda q: [f"1 - 2 * ({q}[3] * {q}[3] + {q}[4] * {q}[4])", f"2 * ({q}[2] * {q}[3] - {q}[4] * {q}[1])", f"2 * ({q}[2] * {q}[4] + {q}[3] * {q}[1])", f"2 * ({q}[2] * {q}[3] + {q}[4] * {q}[1])", f"1 - 2 * ({q}[2] * {q}[2] + {q}[4] * {q}[4])", f"2 * ({q}[3] * {q}[4] - {q}[2] * {q}[1])", f"2 * ({q}[2] * {q}[4] - {q}[3] * {q}[1])", f"2 * ({q}[3] * {q}[4] + {q}[2] * {q}[1])", f"1 - 2 * ({q}[2] * {q}[2] + {q}[3] * {q}[3])"]
_r = lambda x, n: f"round({x}, 6) + 0.0 AS {n}"
_MUL = lambda a, b: [f"{a}[1] * {b}[1] - {a}[2] * {b}[2] - {a}[3] * {b}[3] - {a}[4] * {b}[4]", f"{a}[1] * {b}[2] + {a}[2] * {b}[1] + {a}[3] * {b}[4] - {a}[4] * {b}[3]", f"{a}[1] * {b}[3] - {a}[2] * {b}[4] + {a}[3] * {b}[1] + {a}[4] * {b}[2]", f"{a}[1] * {b}[4] + {a}[2] * {b}[3] - {a}[3] * {b}[2] + {a}[4] * {b}[1]"]
_ROW = lambda m, v: " + ".join(f"({x}) * {v}[{k + 1}]" for k, x in enumerate(m))
_DQP = "uq[1] * up[1] + uq[2] * up[2] + uq[3] * up[3] + uq[4] * up[4]"
ORACLE = {
    "quat_matrix": f"WITH {_BASE} SELECT vec_id, " + ", ".join(_r(x, f"m{i}") for i, x in enumerate(_MAT("uq"))) + ", " + ", ".join(_r(f"CASE WHEN uq[1] < 0 THEN -uq[{i + 1}] ELSE uq[{i + 1}] END", f"q{i}") for i in range(4)) + " FROM w",
    "quat_products": f"WITH {_BASE} SELECT vec_id, " + ", ".join(_r(x, f"x{i}") for i, x in enumerate(_MUL("q", "p"))) + ", " + ", ".join(_r(_ROW(_MAT("uq")[3 * i : 3 * i + 3], "a"), f"y{i}") for i in range(3)) + " FROM w",
    "axis_angle": f"""WITH {_BASE}, t AS (SELECT *, sqrt(a[1] * a[1] + a[2] * a[2] + a[3] * a[3]) AS n FROM w), z AS (SELECT vec_id, a, [cos(n / 2), a[1] * sin(n / 2) / n, a[2] * sin(n / 2) / n, a[3] * sin(n / 2) / n] AS k FROM t)
SELECT vec_id, """ + ", ".join(_r(_MAT("k")[i], f"m{i}") for i in (0, 1, 5, 8)) + ", " + ", ".join(f"round(a[{i + 1}], 5) AS a{i}" for i in range(3)) + " FROM z",
    "rot6d_roundtrip": f"""WITH {_BASE}, x AS (SELECT vec_id, list_transform(d[1:3], lambda v: v / sqrt(d[1] * d[1] + d[2] * d[2] + d[3] * d[3])) AS e, d[4:6] AS f FROM w),
y AS (SELECT vec_id, e, [f[1] - (e[1] * f[1] + e[2] * f[2] + e[3] * f[3]) * e[1], f[2] - (e[1] * f[1] + e[2] * f[2] + e[3] * f[3]) * e[2], f[3] - (e[1] * f[1] + e[2] * f[2] + e[3] * f[3]) * e[3]] AS g FROM x),
z AS (SELECT vec_id, e, list_transform(g, lambda v: v / sqrt(g[1] * g[1] + g[2] * g[2] + g[3] * g[3])) AS h FROM y)
SELECT vec_id, """ + ", ".join(_r(f"{c}[{k}]", f"m{i}") for i, (c, k) in enumerate([("e", 1), ("e", 2), ("e", 3), ("h", 1), ("h", 2), ("h", 3)])) + ", " + ", ".join(_r(x, f"m{i}") for i, x in ((6, "e[2] * h[3] - e[3] * h[2]"), (7, "e[3] * h[1] - e[1] * h[3]"), (8, "e[1] * h[2] - e[2] * h[1]"))) + ", TRUE AS same FROM z",
    "euler_matrix": f"WITH {_BASE} SELECT vec_id, " + ", ".join([_r("cos(a[1]) * cos(a[2])", "m0"), _r("cos(a[1]) * sin(a[2]) * cos(a[3]) + sin(a[1]) * sin(a[3])", "m2"), _r("sin(a[1]) * sin(a[2]) * sin(a[3]) + cos(a[1]) * cos(a[3])", "m4"), _r("cos(a[2]) * sin(a[3])", "m7")]) + " FROM w",
    "slerp": f"""WITH {_BASE}, t AS (SELECT *, {_DQP} AS dot FROM w), z AS (SELECT *, acos(least(abs(dot), 1.0)) AS g FROM t)
SELECT vec_id, """ + ", ".join(_r(f"sin(0.75::DOUBLE * g) / sin(g) * uq[{i}] + sin(0.25::DOUBLE * g) / sin(g) * CASE WHEN dot < 0 THEN -1 ELSE 1 END * up[{i}]", f"x{i - 1}") for i in range(1, 5)) + ", 1.0::DOUBLE AS size FROM z",
    "geodesic": f"WITH {_BASE} SELECT vec_id, round(2 * acos(least(abs({_DQP}), 1.0)), 6) + 0.0 AS angle FROM w",
}
