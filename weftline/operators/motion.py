"""Motion as features that don't depend on place and heading, and back.

Frames are rows (seq_id, frame, ...) with flat arrays: positions (3 a joint, y is up)
or rots (9 a joint). Rows without the array, or with an array of another length than
the skeleton's, are dropped before anything looks at their neighbours. Sequences are
windows, so their frames are sorted once; what needs no other frame is a column
expression, or an Arrow batch where chains of joints are followed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import rotations as R
from weftline.operators import kinematics as K
from weftline.operators.skeleton import _between, _rotate, _times, usable

def _order():
    return Window.partitionBy("seq_id").orderBy("frame")


def _so_far():
    return _order().rowsBetween(Window.unboundedPreceding, 0)


def _before():
    return _order().rowsBetween(Window.unboundedPreceding, -1)


class Across(NamedTuple):
    """Joints that give the body's side: two right ones, two left ones, hips first."""

    right_hip: int
    left_hip: int
    right_shoulder: int
    left_shoulder: int


def _side(positions: Column, across: Across, axis: int) -> Column:
    at = lambda j: F.get(positions, 3 * j + axis)
    return at(across.right_hip) - at(across.left_hip) + at(across.right_shoulder) - at(across.left_shoulder)


def smoothed(value: str, sigma: float, nearest: bool = False) -> Column:
    """Gaussian smoothing of a sequence; beyond its ends are zeros, or its end values."""
    if not nearest:
        return K.gaussian(value, sigma)
    radius = math.floor(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    first, last = F.first(value).over(_order()), F.last(value).over(_order().rowsBetween(0, Window.unboundedFollowing))
    terms = [F.coalesce(F.lag(value, -i).over(_order()), last if i > 0 else first) * (w / sum(weights)) for i, w in zip(range(-radius, radius + 1), weights, strict=True)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def with_forward(frames: DataFrame, across: Across, sigma: float | None = None, nearest: bool = False) -> DataFrame:
    """Frames with the unit vector (fx, fz) that the body faces; (0, 1) where its side has no length.

    The front is a quarter turn from the side, whose direction is from the left joints to
    the right ones. With `sigma` it is smoothed over the sequence and made a unit vector again.
    """

    def unit(x: DataFrame) -> DataFrame:
        size = F.sqrt(F.col("fx") * F.col("fx") + F.col("fz") * F.col("fz"))
        return x.withColumn("_n", size).withColumns({"fx": F.when(F.col("_n") > 0, F.col("fx") / F.col("_n")).otherwise(0.0), "fz": F.when(F.col("_n") > 0, F.col("fz") / F.col("_n")).otherwise(1.0)}).drop("_n")

    x = unit(frames.withColumns({"fx": -_side(F.col("positions"), across, 2), "fz": _side(F.col("positions"), across, 0)}))
    return unit(x.withColumns({"fx": smoothed("fx", sigma, nearest), "fz": smoothed("fz", sigma, nearest)})) if sigma else x


def _turned(v: Column, cos: Column, sin: Column) -> Column:
    """A vector (x, y, z) turned about y, so that (sin, 0, cos) becomes (0, 0, 1)."""
    return F.array(F.get(v, 0) * cos - F.get(v, 2) * sin, F.get(v, 1), F.get(v, 0) * sin + F.get(v, 2) * cos)


def _joints(positions: Column, body) -> Column:
    """body(joint's three numbers) for each joint, as one flat array."""
    return F.flatten(F.transform(F.sequence(F.lit(0), (F.size(positions) / 3).cast("int") - 1), lambda j: body(F.slice(positions, (j * 3 + 1).cast("int"), F.lit(3)))))


def rifke_features(frames: DataFrame, joints: int, feet: list[int], across: Across, sigma: float | None = None, softness: float = 0.5) -> DataFrame:
    """(seq_id, frame, root_y, local, turn, vx, vz): poses seen from the body's own front.

    Joint 0 is the root; `local` has the other joints, relative to the point below the
    root, and turned to the front. Heights are above the floor, a soft minimum of the
    sequence's lowest feet. `turn` and (vx, vz) are the change of the heading and of the
    root's place since the frame before, 0 for the first, in the frame's own heading.
    """
    x = usable(frames.select("seq_id", "frame", "positions"), "positions", 3 * joints)
    x = x.withColumn("_foot", F.least(*[F.get("positions", 3 * j + 1) for j in feet]) if len(feet) > 1 else F.get("positions", 3 * feet[0] + 1))
    x = with_forward(x.withColumn("_floor", K.softmin_height("_foot", softness)), across, sigma)
    x = x.withColumns({"_x": F.get("positions", 0), "_z": F.get("positions", 2), "_a": F.atan2("fx", "fz")})
    step = lambda c: F.coalesce(F.col(c) - F.lag(c).over(_order()), F.lit(0.0))
    x = x.withColumns({"_dx": step("_x"), "_dz": step("_z"), "turn": step("_a")})
    cos, sin = F.col("fz"), F.col("fx")
    rest = F.slice("positions", 4, 3 * (joints - 1))
    local = _joints(rest, lambda p: _turned(F.array(F.get(p, 0) - F.col("_x"), F.get(p, 1) - F.col("_floor"), F.get(p, 2) - F.col("_z")), cos, sin)) if joints > 1 else F.array().cast("array<double>")
    return x.select("seq_id", "frame", (F.get("positions", 1) - F.col("_floor")).alias("root_y"), local.alias("local"), "turn", (F.col("_dx") * cos - F.col("_dz") * sin).alias("vx"), (F.col("_dx") * sin + F.col("_dz") * cos).alias("vz"))


def rifke_positions(features: DataFrame) -> DataFrame:
    """(seq_id, frame, positions): the motion again, from the origin and facing z in its first frame."""
    total = lambda c: F.sum(c).over(_so_far())
    x = features.withColumn("_a", total("turn") - F.first("turn").over(_so_far()))
    cos, sin = F.cos("_a"), -F.sin("_a")  # the other way round
    x = x.withColumns({"_dx": F.col("vx") * cos - F.col("vz") * sin, "_dz": F.col("vx") * sin + F.col("vz") * cos})
    x = x.withColumns({"_x": total("_dx") - F.first("_dx").over(_so_far()), "_z": total("_dz") - F.first("_dz").over(_so_far())})
    moved = lambda p: R._let(_turned(p, cos, sin), lambda q: F.array(F.get(q, 0) + F.col("_x"), F.get(q, 1), F.get(q, 2) + F.col("_z")))
    rest = F.when(F.size("local") > 0, _joints(F.col("local"), moved)).otherwise(F.array().cast("array<double>"))
    return x.select("seq_id", "frame", F.concat(F.array("_x", "root_y", "_z"), rest).alias("positions"))


def canonical_positions(frames: DataFrame, joints: int, across: Across) -> DataFrame:
    """(seq_id, frame, positions) on the floor, from the origin, facing z in the first frame.

    The sequence's lowest joint touches the floor. Its first frame, carried through the
    sequence, gives the place and the turn.
    """
    x = usable(frames.select("seq_id", "frame", "positions"), "positions", 3 * joints)
    x = with_forward(x, across).withColumn("_low", F.array_min(F.filter("positions", lambda v, i: i % 3 == 1)))
    first = lambda c: F.first(c).over(_so_far())
    x = x.withColumns({"_floor": F.min("_low").over(Window.partitionBy("seq_id")), "_x": first(F.get("positions", 0)), "_z": first(F.get("positions", 2)), "_sin": first("fx"), "_cos": first("fz")})
    placed = _joints(F.col("positions"), lambda p: _turned(F.array(F.get(p, 0) - F.col("_x"), F.get(p, 1) - F.col("_floor"), F.get(p, 2) - F.col("_z")), F.col("_cos"), F.col("_sin")))
    return x.select("seq_id", "frame", placed.alias("positions"))


def _lists(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x.reshape(len(x), -1))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _sixd(q: np.ndarray) -> np.ndarray:
    """The first two columns of the matrices of unit quaternions (..., 4)."""
    one, two = np.zeros(3), np.zeros(3)
    one[0] = two[1] = 1
    shape = (*q.shape[:-1], 3)
    return np.concatenate((_rotate(q, np.broadcast_to(one, shape)), _rotate(q, np.broadcast_to(two, shape))), -1)


def motion_vectors(frames: DataFrame, offsets: list[list[float]], chains: list[list[int]], across: Across, feet: list[int], threshold: float = 0.002, sigma: float | None = 20.0) -> DataFrame:
    """(seq_id, frame, turn, vx, vz, height, local, rotations, velocities, contacts), n - 1 rows a sequence.

    turn: half the change of heading to the next frame, the shorter way, so that a body that
    passes its back keeps turning; (vx, vz): the root's step to it in the
    next frame's heading; height: of the root. local: the other joints from the point below the
    root, in the frame's heading; rotations: their first two columns each, from the directions
    of bones along the chains (lists of joints, each seen from the root's heading);
    velocities: the steps of all joints in the frame's heading; contacts: feet whose squared
    step is below the threshold. The first frame faces z; headings are smoothed by `sigma`.
    """
    n = len(offsets)
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    x = with_forward(usable(frames.select("seq_id", "frame", "positions"), "positions", 3 * n), across, sigma, nearest=True)
    half = F.when(F.lag("frame").over(_order()).isNull(), 0.0).otherwise(-F.atan2("fx", "fz") / 2)
    x = x.withColumn("half", half)
    x = x.withColumns({"half_2": F.lead("half").over(_order()), "positions_2": F.lead("positions").over(_order())}).where("half_2 is not null")
    bones = np.array(offsets, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            p, p2 = (b.column(c).flatten().to_numpy().reshape(-1, n, 3) for c in ("positions", "positions_2"))
            h, h2 = b.column("half").to_numpy(), b.column("half_2").to_numpy()
            about = lambda a: np.stack((np.cos(a), 0 * a, np.sin(a), 0 * a), -1)
            q, q2 = about(h), about(h2)
            every = lambda q: np.broadcast_to(q[:, None], (len(q), n, 4))  # noqa: E731, B023
            step = _rotate(q2, p2[:, 0] - p[:, 0])
            ground = p - p[:, :1] * np.array([1.0, 0.0, 1.0])
            turns = np.zeros((len(p), n, 4))
            turns[..., 0] = 1
            for chain in chains:
                before = q
                for a, c in zip(chain[:-1], chain[1:], strict=True):
                    whole = _between(np.broadcast_to(bones[c], (len(p), 3)), p[:, c] - p[:, a])
                    turns[:, c] = _times(before * np.array([1.0, -1.0, -1.0, -1.0]), whole)
                    before = whole
            moved = p2 - p
            flags = (moved[:, feet] ** 2).sum(-1) < threshold
            yield pa.record_batch({
                "seq_id": b.column("seq_id"), "frame": b.column("frame"), "turn": np.arcsin(np.clip(np.sin(h2 - h) * np.where(np.cos(h2 - h) < 0, -1, 1), -1, 1)), "vx": step[:, 0], "vz": step[:, 2], "height": p[:, 0, 1],
                "local": _lists(_rotate(every(q), ground)[:, 1:]), "rotations": _lists(_sixd(turns)[:, 1:]), "velocities": _lists(_rotate(every(q), moved)), "contacts": _lists(flags.astype(np.int32)),
            })

    return x.select("seq_id", "frame", "positions", "half", "positions_2", "half_2").mapInArrow(run, f"seq_id {kinds['seq_id']}, frame {kinds['frame']}, turn double, vx double, vz double, height double, local array<double>, rotations array<double>, velocities array<double>, contacts array<int>")


def recover_positions(vectors: DataFrame) -> DataFrame:
    """(seq_id, frame, positions) from motion vectors, along the integrated path of the root.

    Steps are in the heading of the frame they lead to. The path begins at the origin,
    facing z.
    """
    x = vectors.withColumn("_a", F.coalesce(F.sum("turn").over(_before()), F.lit(0.0)))
    back = lambda v, a: R.apply(F.array(F.cos(a), F.lit(0.0), -F.sin(a), F.lit(0.0)), v)
    x = x.withColumn("_step", back(F.array("vx", F.lit(0.0), "vz"), F.col("_a") + F.col("turn")))
    place = lambda i: F.coalesce(F.sum(F.get("_step", i)).over(_before()), F.lit(0.0))
    x = x.withColumns({"_x": place(0), "_z": place(2)})
    moved = lambda p: R._let(back(p, F.col("_a")), lambda q: F.array(F.get(q, 0) + F.col("_x"), F.get(q, 1), F.get(q, 2) + F.col("_z")))
    rest = F.when(F.size("local") > 0, _joints(F.col("local"), moved)).otherwise(F.array().cast("array<double>"))
    return x.select("seq_id", "frame", F.concat(F.array("_x", "height", "_z"), rest).alias("positions"))


def _times_root(rots: Column, cos: Column, sin: Column) -> Column:
    """Flat matrices with the first one turned about z by the angle's inverse."""
    m = [F.get(rots, i) for i in range(9)]
    return F.concat(F.array(*[m[i] * cos + m[3 + i] * sin for i in range(3)], *[m[3 + i] * cos - m[i] * sin for i in range(3)], *m[6:]), F.slice(rots, 10, F.size(rots) - 9))


def velocity_features(frames: DataFrame, joints: int, canonical: bool = True, quarter: bool = True) -> DataFrame:
    """(seq_id, frame, height, vx, vy, poses, turned): rotations in six numbers a joint, and steps.

    `frames` has rots (a matrix a joint, the root first) and trans (3; z is up). Steps are 0
    in the first frame. If `canonical`, the whole sequence is turned back about z by its first
    root rotation's part of the axis-angle vector on that axis, and a quarter turn more with
    `quarter`; `turned` is that angle, for the inverse.
    """
    x = usable(usable(frames.select("seq_id", "frame", "rots", "trans"), "rots", 9 * joints), "trans", 3)
    first = F.first(F.slice("rots", 1, 9)).over(_so_far())
    angle = (F.get(R.matrix_to_axis_angle(F.col("_first")), 2) + (math.pi / 2 if quarter else 0.0)) if canonical else F.lit(0.0)
    x = x.withColumn("_first", first).withColumn("turned", angle).withColumns({"_cos": F.cos("turned"), "_sin": F.sin("turned")})
    step = lambda i: F.coalesce(F.get("trans", i) - F.lag(F.get("trans", i)).over(_order()), F.lit(0.0))
    x = x.withColumns({"_dx": step(0), "_dy": step(1)})
    vx, vy = F.col("_dx") * F.col("_cos") + F.col("_dy") * F.col("_sin"), F.col("_dy") * F.col("_cos") - F.col("_dx") * F.col("_sin")
    turned = _times_root(F.col("rots"), F.col("_cos"), F.col("_sin"))
    poses = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(joints - 1)), lambda j: F.slice(turned, (j * 9 + 1).cast("int"), F.lit(6))))
    return x.select("seq_id", "frame", F.get("trans", 2).alias("height"), vx.alias("vx"), vy.alias("vy"), poses.alias("poses"), "turned")


def velocity_inverse(features: DataFrame, undo: bool = False) -> DataFrame:
    """(seq_id, frame, rots, trans) from the origin; with `undo` in the orientation of the input."""
    total = lambda c: F.sum(c).over(_so_far()) - F.first(c).over(_so_far())
    x = features.withColumns({"_x": total("vx"), "_y": total("vy")})
    rots = F.flatten(F.transform(F.sequence(F.lit(0), (F.size("poses") / 6).cast("int") - 1), lambda j: R.sixd_to_matrix(F.slice("poses", (j * 6 + 1).cast("int"), F.lit(6)))))
    x = x.withColumn("rots", rots)
    if undo:
        cos, sin = F.cos("turned"), F.sin("turned")
        x = x.withColumn("rots", _times_root(F.col("rots"), cos, -sin)).withColumns({"_x": F.col("_x") * cos - F.col("_y") * sin, "_y": F.col("_x") * sin + F.col("_y") * cos})
    return x.select("seq_id", "frame", "rots", F.array("_x", "_y", "height").alias("trans"))


class Joint(NamedTuple):
    """A joint of a named hierarchy: its parent (None: the root), offset, and order of rotation channels."""

    name: str
    parent: str | None
    offset: tuple[float, float, float]
    order: str = "ZXY"


def _channels(tracks: DataFrame, joints: list[Joint]) -> DataFrame:
    """(seq_id, frame, values): a row a frame, with all channels in the order of the joints.

    Absent rotations and positions count as 0.
    """
    names = [f"{j.name}_{a}rotation" for j in joints for a in j.order] + [f"{j.name}_{a}position" for j in joints for a in "XYZ"]
    x = tracks.where(F.col("channel").isin(names) & F.col("value").isNotNull())
    x = x.groupBy("seq_id", "frame").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("channel", F.col("value").cast("double"))))).alias("m"))
    return x.select("seq_id", "frame", F.array(*[F.coalesce(F.try_element_at("m", F.lit(n)), F.lit(0.0)) for n in names]).alias("values"))


def _euler(angles: np.ndarray, order: str) -> np.ndarray:
    """Quaternions (n, 4) of three turns in degrees (n, 3), the first outermost."""
    out = None
    for k, axis in enumerate(order):
        half = np.radians(angles[:, k]) / 2
        q = np.zeros((len(half), 4))
        q[:, 0], q[:, 1 + "XYZ".index(axis)] = np.cos(half), np.sin(half)
        out = q if out is None else _times(out, q)
    return out


def mocap_positions(tracks: DataFrame, joints: list[Joint]) -> DataFrame:
    """(seq_id, frame, joint, x, y, z): joint positions from long tracks (seq_id, frame, channel, value).

    Channels are named like `Hips_Xrotation` (degrees) and `Hips_Xposition`. The root stands
    at its position channels; others at their parent's place, by their offset and position
    channels as the parent's global rotation turns them. Joints come parents first.
    """
    kinds = {f.name: f.dataType.simpleString() for f in tracks.schema}
    at, n = {j.name: i for i, j in enumerate(joints)}, len(joints)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("values").flatten().to_numpy().reshape(b.num_rows, 2, n, 3)
            place, turn = np.empty((b.num_rows, n, 3)), np.empty((b.num_rows, n, 4))
            for i, j in enumerate(joints):
                own = _euler(v[:, 0, i], j.order)
                if j.parent is None:
                    place[:, i], turn[:, i] = v[:, 1, i], own
                else:
                    up = at[j.parent]
                    place[:, i] = place[:, up] + _rotate(turn[:, up], v[:, 1, i] + np.array(j.offset))
                    turn[:, i] = _times(turn[:, up], own)
            yield pa.record_batch({"seq_id": b.column("seq_id"), "frame": b.column("frame"), "places": _lists(place)})

    placed = _channels(tracks, joints).mapInArrow(run, f"seq_id {kinds['seq_id']}, frame {kinds['frame']}, places array<double>")
    names = F.array(*[F.lit(j.name) for j in joints])
    x = placed.select("seq_id", "frame", "places", F.posexplode(names).alias("i", "joint"))
    return x.select("seq_id", "frame", "joint", *[F.get("places", F.col("i") * 3 + k).alias(c) for k, c in enumerate("xyz")])


def _per_joint(tracks: DataFrame, joints: list[Joint]) -> DataFrame:
    """(seq_id, frame, joint, order, angles in radians)."""
    x = _channels(tracks, joints)
    parts = F.array(*[F.struct(F.lit(j.name).alias("joint"), F.lit(j.order).alias("order"), F.array(*[F.radians(F.get("values", 3 * i + k)) for k in range(3)]).alias("angles")) for i, j in enumerate(joints)])
    return x.select("seq_id", "frame", F.explode(parts).alias("p")).select("seq_id", "frame", "p.*")


def _by_order(joints: list[Joint], body) -> Column:
    """body(order) for the row's own order, of those that the joints have."""
    out = None
    for order in sorted({j.order for j in joints}):
        out = F.when(F.col("order") == order, body(order)) if out is None else out.when(F.col("order") == order, body(order))
    return out


def mocap_exponential(tracks: DataFrame, joints: list[Joint]) -> DataFrame:
    """(seq_id, frame, joint, order, alpha, beta, gamma): axis-angle vectors of Euler channels.

    Through a sequence the quaternions keep the nearer sign, so that vectors grow beyond half
    a turn instead of jumping to the other side.
    """
    x = _per_joint(tracks, joints)
    x = x.withColumn("q", R.matrix_to_quaternion(_by_order(joints, lambda order: R.euler_to_matrix(F.col("angles"), order))))
    x = K.quaternion_continuity(x.withColumn("seq_id", F.struct("seq_id", "joint")))
    v = R.log(F.col("q"))
    return x.withColumn("v", v).select("seq_id.seq_id", "frame", "joint", "order", *[(2 * F.get("v", i)).alias(c) for i, c in enumerate(("alpha", "beta", "gamma"))])


def exponential_tracks(vectors: DataFrame, joints: list[Joint]) -> DataFrame:
    """(seq_id, frame, channel, value): Euler channels in degrees again, in each joint's order."""
    q = R.exp(F.array(*[F.col(c) / 2 for c in ("alpha", "beta", "gamma")]))
    x = vectors.withColumn("m", R.quaternion_to_matrix(q)).withColumn("angles", _by_order(joints, lambda order: R.matrix_to_euler(F.col("m"), order)))
    parts = F.array(*[F.struct(F.concat("joint", F.lit("_"), F.substring("order", k + 1, 1), F.lit("rotation")).alias("channel"), F.degrees(F.get("angles", k)).alias("value")) for k in range(3)])
    return x.select("seq_id", "frame", F.explode(parts).alias("p")).select("seq_id", "frame", "p.*")
