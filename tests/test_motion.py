"""Motion features against loops over frames, and on rows with odd arrays."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import rotations as R
from weftline.operators import motion as M

ACROSS = M.Across(1, 2, 3, 4)
OFFSETS, CHAINS = [[0, 0, 0], [1, -1, 0], [-1, -1, 0], [1, 2, 0], [-1, 2, 0]], [[0, 1, 3], [0, 2, 4]]


def poses(n=40, seed=1):
    """Two walking sequences that turn, and rows that must be dropped."""
    r = np.random.default_rng(seed)
    rows, kept = [], {}
    for s in range(2):
        for f in range(n):
            a = 0.15 * f + s
            turn = np.array([[math.cos(a), 0, math.sin(a)], [0, 1, 0], [-math.sin(a), 0, math.cos(a)]])
            p = (np.array(OFFSETS) + 0.1 * r.standard_normal((5, 3))) @ turn.T + [0.3 * f, 1 + 0.1 * s, -0.2 * f]
            kept[s, f] = p
            rows.append((s, f, [float(x) for x in p.ravel()]))
    odd = [(0, n + 1, None), (0, n + 2, [1.0] * 14), (1, n + 1, [float("nan")] + [0.0] * 14), (1, n + 2, [None] + [0.0] * 14), (2, 0, [])]
    return rows + odd, kept


def frame(spark, rows):
    return spark.createDataFrame(rows, "seq_id int, frame int, positions array<double>").repartition(3)


def collected(df, column="positions"):
    return {(r.seq_id, r.frame): np.array(r[column]) for r in df.collect()}


def about(a):
    """The turn that brings (sin a, 0, cos a) to z."""
    return np.array([[math.cos(a), 0, -math.sin(a)], [0, 1, 0], [math.sin(a), 0, math.cos(a)]])


@pytest.mark.parametrize("sigma", [None, 2.0])
def test_rifke_round_trip(spark, sigma):
    rows, kept = poses()
    x = M.rifke_features(frame(spark, rows), 5, [1, 2], ACROSS, sigma)
    features = {(r.seq_id, r.frame): r for r in x.collect()}
    back = collected(M.rifke_positions(x))
    assert set(back) == set(kept)
    for s in range(2):
        p = [kept[s, f] for f in range(40)]
        feet = [min(q[1, 1], q[2, 1]) for q in p]
        ground = min(feet) - math.log(0.5 + math.exp(min(feet) - max(feet)))
        fronts = np.array([[-(q[1, 2] - q[2, 2] + q[3, 2] - q[4, 2]), q[1, 0] - q[2, 0] + q[3, 0] - q[4, 0]] for q in p])
        fronts /= np.linalg.norm(fronts, axis=1, keepdims=True)
        if sigma:
            w = np.exp(-0.5 * (np.arange(-8, 9) / sigma) ** 2)
            padded = np.pad(fronts, ((8, 8), (0, 0)))
            fronts = np.array([(padded[i : i + 17] * (w / w.sum())[:, None]).sum(0) for i in range(40)])
            fronts /= np.linalg.norm(fronts, axis=1, keepdims=True)
        angles = np.arctan2(fronts[:, 0], fronts[:, 1])
        for f in range(40):
            local = ((p[f][1:] - [p[f][0, 0], ground, p[f][0, 2]]) @ about(angles[f]).T).ravel()
            step = about(angles[f]) @ (p[f][0] - p[max(f - 1, 0)][0])
            got = features[s, f]
            assert np.allclose(got.local, local, atol=1e-9)
            assert np.allclose([got.root_y, got.vx, got.vz], [p[f][0, 1] - ground, step[0], step[2]], atol=1e-9)
            want = (p[f] - [p[0][0, 0], ground, p[0][0, 2]]) @ about(angles[0]).T
            assert np.allclose(back[s, f], want.ravel(), atol=1e-6)


def test_motion_vectors_and_positions_again(spark):
    rows, kept = poses()
    canonical = M.canonical_positions(frame(spark, rows), 5, ACROSS)
    start = collected(canonical)
    x = M.motion_vectors(canonical, OFFSETS, CHAINS, ACROSS, [1, 2], 0.05, sigma=3.0)
    got = x.collect()
    assert len(got) == 2 * 39
    assert {len(r.local) for r in got} == {12} and {len(r.rotations) for r in got} == {24} and {len(r.velocities) for r in got} == {15}
    back = collected(M.recover_positions(x))
    for (s, f), p in back.items():
        assert np.allclose(p, start[s, f], atol=1e-6)
    for s in range(2):
        assert min(p.reshape(5, 3)[:, 1].min() for (q, _), p in start.items() if q == s) == pytest.approx(0)
        assert np.allclose(start[s, 0][[0, 2]], 0)
    # the rotations give the directions of the bones, from the heading on
    half, by = 0.0, {(r.seq_id, r.frame): r for r in got}
    for f in range(39):
        r = by[0, f]
        p = start[0, f].reshape(5, 3)
        turns = {}
        for chain in CHAINS:
            whole = about(-2 * half)
            for a, c in zip(chain[:-1], chain[1:], strict=True):
                d = np.array(r.rotations).reshape(4, 6)[c - 1]
                m = np.stack((d[:3], d[3:], np.cross(d[:3], d[3:])), 1)
                whole = whole @ m
                bone, way = np.array(OFFSETS[c], float), p[c] - p[a]
                assert np.allclose(whole @ bone / np.linalg.norm(bone), way / np.linalg.norm(way), atol=1e-6)
                turns[c] = whole
        half += r.turn


@pytest.mark.parametrize("canonical", [True, False])
def test_velocity_features_come_back(spark, canonical):
    r = random.Random(5)
    rows = [(s, f, [r.gauss(0, 1) for _ in range(12)], [f * 0.1 + s, -f * 0.2, 1.0 + f]) for s in range(2) for f in range(20)]
    rots = F.concat(*[R.sixd_to_matrix(F.slice("six", 6 * k + 1, 6)) for k in range(2)])
    x = spark.createDataFrame(rows, "seq_id int, frame int, six array<double>, trans array<double>").withColumn("rots", rots)
    odd = spark.createDataFrame([(0, 99, None, [1.0] * 3), (0, 98, [1.0] * 18, None), (0, 97, [1.0] * 18, [1.0, None, 1.0])], "seq_id int, frame int, rots array<double>, trans array<double>")
    both = x.select("seq_id", "frame", "rots", "trans").union(odd)
    start = {(q.seq_id, q.frame): q for q in x.collect()}
    got = M.velocity_inverse(M.velocity_features(both, 2, canonical), undo=True).collect()
    assert len(got) == 40
    for q in got:
        want = start[q.seq_id, q.frame]
        assert np.allclose(q.rots, want.rots, atol=1e-6)
        assert np.allclose(q.trans, np.array(want.trans) - np.array([*start[q.seq_id, 0].trans[:2], 0]), atol=1e-6)


def test_mocap_in_every_order(spark):
    """A chain of six joints, each with another order of its turns."""
    r = random.Random(3)
    orders = ["XYZ", "XZY", "YXZ", "YZX", "ZXY", "ZYX"]
    joints = [M.Joint(f"J{o}", f"J{orders[i - 1]}" if i else None, (0.5, 2.0, float(i)), o) for i, o in enumerate(orders)]
    angles = {(f, j.name): [r.uniform(-80, 80) for _ in range(3)] for f in range(9) for j in joints}
    rows = [(1, f, f"{j}_{a}rotation", v) for (f, j), x in angles.items() for a, v in zip(j[1:], x, strict=True)]
    rows += [(1, f, f"JXYZ_{a}position", float(f + k)) for f in range(9) for k, a in enumerate("XYZ")]
    rows += [(1, 3, "JXYZ_Wrotation", 5.0), (1, 4, "Other_Xrotation", 5.0), (2, 0, "JXYZ_Xposition", None)]
    tracks = spark.createDataFrame(rows, "seq_id int, frame int, channel string, value double")
    axis = {"X": np.array([1.0, 0, 0]), "Y": np.array([0, 1.0, 0]), "Z": np.array([0, 0, 1.0])}

    def turn(a, deg):
        k, t = axis[a], math.radians(deg)
        cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
        return np.eye(3) + math.sin(t) * cross + (1 - math.cos(t)) * cross @ cross

    whole = lambda x, order: np.linalg.multi_dot([turn(a, v) for a, v in zip(order, x, strict=True)])
    places = {(q.frame, q.joint): np.array([q.x, q.y, q.z]) for q in M.mocap_positions(tracks, joints).collect()}
    for f in range(9):
        at, all_turns = np.array([f, f + 1.0, f + 2.0]), np.eye(3)
        for i, j in enumerate(joints):
            at = at + all_turns @ np.array(j.offset) if i else at
            assert np.allclose(places[f, j.name], at)
            all_turns = all_turns @ whole(angles[f, j.name], j.order)
    back = {(q.frame, q.channel): q.value for q in M.exponential_tracks(M.mocap_exponential(tracks, joints), joints).collect()}
    for (f, j), x in angles.items():
        assert np.allclose([back[f, f"{j}_{a}rotation"] for a in j[1:]], x, atol=1e-5)


def test_exponential_maps_do_not_jump(spark):
    joints = [M.Joint("Hips", None, (0, 0, 0), "ZXY")]
    rows = [(1, f, "Hips_Zrotation", float((10 * f + 180) % 360 - 180)) for f in range(34)]
    got = M.mocap_exponential(spark.createDataFrame(rows, "seq_id int, frame int, channel string, value double"), joints).orderBy("frame").collect()
    assert np.allclose([q.gamma for q in got], [math.radians(10 * f) for f in range(34)], atol=1e-9)
