"""Skeletons: kinematic chains, mean rotations, motion features and their inverse.

Frames are rows (seq_id, frame, ...). A skeleton is a list of parents (-1 for the
root, parents before children) and of offsets, as in a motion file's hierarchy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import rotations as R


def _rotate(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    w, u = q[..., :1], q[..., 1:]
    t = 2 * np.cross(u, v)
    return v + w * t + np.cross(u, t)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    aw, av, bw, bv = a[..., :1], a[..., 1:], b[..., :1], b[..., 1:]
    return np.concatenate((aw * bw - (av * bv).sum(-1, keepdims=True), aw * bv + bw * av + np.cross(av, bv)), -1)


def usable(frames: DataFrame, column: str, width: int) -> DataFrame:
    """Frames whose array has the width, and no null or non-finite component."""
    x = F.col(column)
    ok = (F.size(x) == width) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return frames.withColumn(column, x.cast("array<double>")).where(F.coalesce(ok, F.lit(False)))


def _unit(q: np.ndarray) -> np.ndarray:
    """Unit quaternions; those of length 0 turn nothing."""
    size = np.linalg.norm(q, axis=-1, keepdims=True)
    return np.where(size > 0, q / np.where(size > 0, size, 1), np.array([1.0, 0.0, 0.0, 0.0]))


def forward_kinematics(frames: DataFrame, parents: list[int], offsets: list[list[float]]) -> DataFrame:
    """(seq_id, frame, positions, rotations): flat global arrays of all joints.

    `frames` has root (3) and quats (4 a joint, local). Batches of frames go
    through the chain joint by joint. Frames without a whole root or pose are left
    out; a quaternion of length 0 turns nothing.
    """
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    bones = np.array(offsets, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            q = batch.column("quats").flatten().to_numpy(zero_copy_only=False).reshape(n, -1, 4)
            q = _unit(q)
            place, turn = np.empty((n, len(parents), 3)), np.empty((n, len(parents), 4))
            for j, p in enumerate(parents):
                if p < 0:
                    place[:, j], turn[:, j] = batch.column("root").flatten().to_numpy(zero_copy_only=False).reshape(n, 3), q[:, j]
                else:
                    place[:, j] = place[:, p] + _rotate(turn[:, p], np.broadcast_to(bones[j], (n, 3)))
                    turn[:, j] = _times(turn[:, p], q[:, j])
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (x.size // max(n, 1)), pa.int32()), pa.array(x.reshape(-1)))
            yield pa.record_batch({"seq_id": batch.column("seq_id"), "frame": batch.column("frame"), "positions": lists(place), "rotations": lists(turn)})

    x = usable(usable(frames.select("seq_id", "frame", "root", "quats"), "root", 3), "quats", 4 * len(parents))
    return x.mapInArrow(run, f"seq_id {kinds['seq_id']}, frame {kinds['frame']}, positions array<double>, rotations array<double>")


def mean_rotations(rows: DataFrame, key: str) -> DataFrame:
    """(key, mean): the average of unit quaternions q, whatever their signs.

    The sum of outer products is an aggregate of ten numbers a group; its
    dominant eigenvector is the mean, with a positive real part.
    """
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    sums = rows.groupBy(key).agg(*[F.sum(F.get("q", i) * F.get("q", j)).alias(f"m{i}{j}") for i, j in pairs])
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.empty((batch.num_rows, 4, 4))
            for i, j in pairs:
                m[:, i, j] = m[:, j, i] = batch.column(f"m{i}{j}").to_numpy(zero_copy_only=False)
            v = np.linalg.eigh(m)[1][:, :, -1]
            v = np.where(v[:, :1] < 0, -v, v)
            yield pa.record_batch({key: batch.column(key), "mean": pa.array(v.tolist(), pa.list_(pa.float64()))})

    return sums.mapInArrow(run, f"{key} {kind}, mean array<double>")


def motion_features(frames: DataFrame, root: int = 0, threshold: float = 0.01) -> DataFrame:
    """Root turn, root velocity, height, local positions and contacts; n - 1 rows.

    `frames` has heading (a quaternion about the vertical axis that turns the
    world to the body's front) and positions (3 a joint). Positions are taken
    relative to the root's ground point and turned to the front; velocities are
    turned by the heading of their first frame.
    """
    order = Window.partitionBy("seq_id").orderBy("frame")
    point = lambda c: F.slice(c, 3 * root + 1, 3)
    x = frames.withColumns({"_h": F.lead("heading").over(order), "_p": F.lead("positions").over(order)}).where("_h is not null")
    p, h = F.col("positions"), F.col("heading")
    ground = lambda i: F.when(i % 3 == 1, 0.0).otherwise(F.get(p, (3 * root + i % 3).cast("int")))
    local = F.transform(p, lambda v, i: v - ground(i))
    joints = F.sequence(F.lit(0), (F.size(p) / 3).cast("int") - 1)
    turned = F.flatten(F.transform(joints, lambda j: R.apply(h, F.slice(local, j * 3 + 1, F.lit(3)))))
    step = F.zip_with(point(F.col("_p")), point(p), lambda a, b: a - b)
    moved = F.zip_with("_p", p, lambda a, b: (a - b) * (a - b))
    speed = lambda j: F.get(moved, j * 3) + F.get(moved, j * 3 + 1) + F.get(moved, j * 3 + 2)
    turn = R.multiply(F.col("_h"), R.invert(h))
    velocity = R.apply(h, step)
    return x.select("seq_id", "frame", F.asin(F.greatest(F.least(F.get(turn, 2), F.lit(1.0)), F.lit(-1.0))).alias("root_turn"), F.get(velocity, 0).alias("vx"), F.get(velocity, 2).alias("vz"), F.get(point(p), 1).alias("height"), turned.alias("local"), F.transform(joints, lambda j: (speed(j) < threshold).cast("int")).alias("contacts"))


def recover_root(features: DataFrame) -> DataFrame:
    """(seq_id, frame, angle, x, y, z): the root's path from its features.

    Angles and steps are summed from the first frame, which is the origin and
    faces front; `angle` is half the turn, as in the heading quaternion.
    """
    order = Window.partitionBy("seq_id").orderBy("frame")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    x = features.withColumn("angle", total("root_turn"))
    back = _turn_y(F.array("vx", F.lit(0.0), "vz"), -F.col("angle"))
    x = x.withColumns({"_dx": F.get(back, 0), "_dz": F.get(back, 2)})
    return x.select("seq_id", "frame", "angle", total("_dx").alias("x"), F.col("height").alias("y"), total("_dz").alias("z"))


def _turn_y(v: Column, half: Column) -> Column:
    """A vector turned about the vertical axis by twice the given angle."""
    return R.apply(F.array(F.cos(half), F.lit(0.0), F.sin(half), F.lit(0.0)), v)


def whole_pose(parts: dict[str, Column], masks: dict[str, list[int]]) -> Column:
    """The full pose from its parts: each put back by its mask, then added."""
    from weftline.operators.features import mask_scatter

    out = None
    for name, part in parts.items():
        full = mask_scatter(part, masks[name])
        out = full if out is None else F.zip_with(out, full, lambda a, b: a + b)
    return out


def _between(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Unit quaternions that turn the directions u to v (..., 3)."""
    w = np.sqrt((u * u).sum(-1) * (v * v).sum(-1)) + (u * v).sum(-1)
    q = np.concatenate((w[..., None], np.cross(u, v)), -1)
    size = np.linalg.norm(q, axis=-1, keepdims=True)
    return np.where(size > 1e-12, q / np.maximum(size, 1e-300), np.array([0.0, 0.0, 0.0, 1.0]))


def inverse_kinematics(frames: DataFrame, parents: list[int], offsets: list[list[float]]) -> DataFrame:
    """(seq_id, frame, root, quats): local rotations whose chain points along the positions.

    `frames` has heading (the root's quaternion) and positions (3 a joint). Every
    joint turns its first child's offset to the direction of that child; joints
    without a child keep their parent's direction. forward_kinematics of the result
    gives positions with the lengths of the offsets; joints with several children, or
    headings that do not fit, are followed as well as their first child allows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    bones = np.array(offsets, np.float64)
    child = {p: j for j, p in reversed(list(enumerate(parents))) if p >= 0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            place = batch.column("positions").flatten().to_numpy(zero_copy_only=False).reshape(n, -1, 3)
            head = batch.column("heading").flatten().to_numpy(zero_copy_only=False).reshape(n, 4)
            head = _unit(head)
            whole, local = np.empty((n, len(parents), 4)), np.empty((n, len(parents), 4))
            for j, p in enumerate(parents):
                before = head if p < 0 else whole[:, p]
                if j in child:
                    aim = place[:, child[j]] - place[:, j]
                    now = _rotate(before, np.broadcast_to(bones[child[j]], (n, 3)))
                    whole[:, j] = _times(_between(now, aim), before)
                else:
                    whole[:, j] = before
                local[:, j] = whole[:, j] if p < 0 else _times(whole[:, p] * np.array([1.0, -1.0, -1.0, -1.0]), whole[:, j])
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (x.size // max(n, 1)), pa.int32()), pa.array(x.reshape(-1)))
            yield pa.record_batch({"seq_id": batch.column("seq_id"), "frame": batch.column("frame"), "root": lists(np.ascontiguousarray(place[:, parents.index(-1)])), "quats": lists(local)})

    x = usable(usable(frames.select("seq_id", "frame", "positions", "heading"), "positions", 3 * len(parents)), "heading", 4)
    return x.mapInArrow(run, f"seq_id {kinds['seq_id']}, frame {kinds['frame']}, root array<double>, quats array<double>")


def retarget(frames: DataFrame, parents: list[int], offsets: list[list[float]], target: list[list[float]], legs: list[int]) -> DataFrame:
    """Frames (seq_id, frame, heading, positions) on a skeleton of other bone lengths.

    The root's path is scaled by the ratio of the legs' lengths (the bones that end at
    the joints `legs`); directions of bones stay. Columns as in forward_kinematics.
    """
    length = lambda o: float(np.linalg.norm(np.array(o, np.float64)[legs], axis=1).sum())
    ratio = length(target) / length(offsets)
    posed = inverse_kinematics(frames, parents, offsets)
    return forward_kinematics(posed.withColumn("root", F.transform("root", lambda x: x * ratio)), parents, target)
