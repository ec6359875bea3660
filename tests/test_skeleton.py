"""Kinematic chains, mean rotations and motion features."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from weftline.operators import skeleton as S


def about_y(angle):
    return [math.cos(angle / 2), 0.0, math.sin(angle / 2), 0.0]


def test_forward_kinematics(spark):
    q = about_y(math.pi / 2) + [1.0, 0.0, 0.0, 0.0] + [1.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([(0, 0, [1.0, 2.0, 3.0], q)], "seq_id int, frame int, root array<double>, quats array<double>")
    r = S.forward_kinematics(df, [-1, 0, 1], [[0, 0, 0], [1, 0, 0], [0, 1, 0]]).first()
    assert r.positions == pytest.approx([1, 2, 3, 1, 2, 2, 1, 3, 2])
    assert S.forward_kinematics(df.limit(0), [-1, 0, 1], [[0, 0, 0]] * 3).collect() == []


def test_mean_rotation_ignores_signs(spark):
    rows = [(0, about_y(a)) for a in (0.2, 0.4)] + [(0, [-x for x in about_y(0.3)])]
    df = spark.createDataFrame(rows, "k int, q array<double>")
    assert S.mean_rotations(df, "k").first()["mean"] == pytest.approx(about_y(0.3), abs=1e-6)


def test_root_path_comes_back(spark):
    rows, x, z, half = [], 0.0, 0.0, 0.0
    path = []
    for t in range(12):
        rows.append((0, t, [math.cos(half), 0.0, math.sin(half), 0.0], [x, 0.9 + 0.01 * t, z, x + 1.0, 0.5, z]))
        path.append((half, x, z))
        x, z, half = x + 0.1 * t, z - 0.05 * t, half + 0.03
    df = spark.createDataFrame(rows, "seq_id int, frame int, heading array<double>, positions array<double>")
    f = S.motion_features(df)
    assert f.count() == 11 and f.orderBy("frame").first().contacts == [1, 1]
    got = S.recover_root(f).orderBy("frame").collect()
    for r, (half, x, z) in zip(got, path, strict=False):
        assert (r.angle, r.x, r.z) == pytest.approx((half, x, z), abs=1e-9)
        assert r.y == pytest.approx(0.9 + 0.01 * r.frame)


def test_whole_pose(spark):
    masks = {"upper": [1, 0, 1, 0], "lower": [0, 1, 0, 0]}
    parts = {"upper": F.array(F.lit(1.0), F.lit(2.0)), "lower": F.array(F.lit(5.0))}
    assert spark.range(1).select(S.whole_pose(parts, masks).alias("x")).first().x == [1.0, 5.0, 2.0, 0.0]
