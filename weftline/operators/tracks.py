"""Motion tracks in long form: (track, frame, channel, value), channels named joint_axis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_joints(rows: DataFrame, joints: list[str], root: str | None = None) -> DataFrame:
    """Channels whose name contains one of the joints, or the root's name."""
    wanted = [*([root] if root else []), *joints]
    return rows.where(reduce(lambda a, b: a | b, [F.col("channel").contains(j) for j in wanted], F.lit(False)))


def without_groups(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Channels that name none of the body groups."""
    return rows.where(~reduce(lambda a, b: a | b, [F.col("channel").contains(g) for g in groups], F.lit(False)))


def constant_values(rows: DataFrame, track: Column | int, least: float = 1e-9) -> DataFrame:
    """(channel, value): channels that hardly change on one track, with its first value."""
    one = rows.where(F.col("track") == track).groupBy("channel")
    return one.agg(F.stddev_samp("value").alias("s"), F.min_by("value", "frame").alias("value")).where(F.col("s") < least).select("channel", "value")


def remove_channels(rows: DataFrame, constants: DataFrame) -> DataFrame:
    return rows.join(constants.select("channel"), "channel", "left_anti").select(*rows.columns)


def restore_channels(rows: DataFrame, constants: DataFrame) -> DataFrame:
    """The removed channels again, with their constant in every frame."""
    frames = rows.select("track", "frame").distinct()
    back = frames.join(F.broadcast(constants), F.lit(True))  # one row a channel of a skeleton
    return rows.select("track", "frame", "channel", "value").unionByName(back.select("track", "frame", "channel", "value"))


def concat_tracks(*tracks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tracks)


def between_lengths(sequences: DataFrame, column: str, least: int, most: int | None = None) -> DataFrame:
    """Sequences whose array has `least` to `most` entries."""
    n = F.size(column)
    return sequences.where((n >= least) & ((n <= most) if most is not None else F.lit(True)))


def first_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in an order: the cap of a trial run."""
    return rows.orderBy(*order).limit(n)


def root_deltas(rows: DataFrame, root: str) -> DataFrame:
    """The root's x and z positions become differences by frame, 0 at first (dX, dZ)."""
    order = Window.partitionBy("track", "channel").orderBy("frame")
    moved = F.col("channel").isin(f"{root}_Xposition", f"{root}_Zposition")
    delta = F.col("value") - F.coalesce(F.lag("value").over(order), F.col("value"))
    return rows.select("track", "frame", F.when(moved, F.regexp_replace("channel", "_([XZ])position$", "_d$1position")).otherwise(F.col("channel")).alias("channel"), F.when(moved, delta).otherwise(F.col("value")).alias("value"))


def root_positions(rows: DataFrame, root: str, start: dict[str, float] | None = None) -> DataFrame:
    """The inverse of root_deltas: running sums from the start position."""
    order = Window.partitionBy("track", "channel").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    moved = F.col("channel").isin(f"{root}_dXposition", f"{root}_dZposition")
    at = F.lit(0.0)
    for axis, value in (start or {}).items():
        at = F.when(F.col("channel") == f"{root}_d{axis}position", value).otherwise(at)
    return rows.select("track", "frame", F.when(moved, F.regexp_replace("channel", "_d([XZ])position$", "_$1position")).otherwise(F.col("channel")).alias("channel"), F.when(moved, at + F.sum("value").over(order)).otherwise(F.col("value")).alias("value"))


def centred(rows: DataFrame, root: str, inverse: bool = False) -> DataFrame:
    """Positions relative to the root's x and z; `inverse` adds the root back."""
    own = rows.where(F.col("channel").isin(f"{root}_Xposition", f"{root}_Zposition"))
    own = own.select("track", "frame", F.regexp_extract("channel", "_([XZ])position$", 1).alias("axis"), F.col("value").alias("_r"))
    axis = F.regexp_extract("channel", "_([XYZ])position$", 1)
    x = rows.withColumn("axis", axis).join(own, ["track", "frame", "axis"], "left")
    moved = (F.col("value") + F.col("_r")) if inverse else (F.col("value") - F.col("_r"))
    is_root = F.col("channel").startswith(f"{root}_")
    return x.select("track", "frame", "channel", F.when(F.col("_r").isNotNull() & ~is_root, moved).otherwise(F.col("value")).alias("value"))


def to_arrays(rows: DataFrame) -> DataFrame:
    """(track, frame, vec): the channels of a frame as one array, in order of their names."""
    return rows.groupBy("track", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "value"))), lambda x: x["value"]).alias("vec"))


def joint_speeds(frames: DataFrame, dt: float = 1.0) -> DataFrame:
    """(joint, speed): mean norm of the velocity over all frames of all sequences.

    `frames` has seq_id, frame, joint and x, y, z. Velocities are central
    differences, one-sided at the ends.
    """
    order = Window.partitionBy("seq_id", "joint").orderBy("frame")

    def v(c: str) -> Column:
        a, b = F.lag(c).over(order), F.lead(c).over(order)
        return F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull(), (b - F.col(c)) / dt).when(b.isNull(), (F.col(c) - a) / dt).otherwise((b - a) / (2 * dt))

    x = frames.select("joint", *[v(c).alias(c) for c in "xyz"])
    return x.groupBy("joint").agg(F.avg(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).alias("speed"))


def layout(rows: DataFrame, fields: list[str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """The fields of one sample layout, in order; missing ones get their default or null."""
    have, defaults = set(rows.columns), defaults or {}
    return rows.select(*[F.col(c) if c in have else defaults.get(c, F.lit(None)).alias(c) for c in fields])
