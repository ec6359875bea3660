"""Frame-shaped operators: differences, contacts, extrema, integration.

Frames are rows (seq_id, frame, value...); windows are partitioned by sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order():
    return Window.partitionBy("seq_id").orderBy("frame")


def _whole():
    return Window.partitionBy("seq_id")


def velocity(value: str = "value", dt: float = 1.0) -> Column:
    """Forward difference first, backward last, central between; 0 if alone."""
    x, a, b = F.col(value), F.lag(value).over(_order()), F.lead(value).over(_order())
    return F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull(), (b - x) / dt).when(b.isNull(), (x - a) / dt).otherwise((b - a) / (2 * dt))


def delta(value: str = "value") -> Column:
    """First difference, 0 for the first frame."""
    return F.col(value) - F.coalesce(F.lag(value).over(_order()), F.col(value))


def integrate(value: str = "value") -> Column:
    return F.sum(value).over(_order().rowsBetween(Window.unboundedPreceding, 0))


def position(velocity_: str = "value", dt: float = 1.0, start: float = 0.0) -> Column:
    """Positions from velocities: start plus the sum of those before."""
    return start + dt * F.coalesce(F.sum(velocity_).over(_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))


def contact(value: str = "value", threshold: float = 0.01) -> Column:
    """1 where the next frame is nearer than the threshold; the last is 1."""
    return (F.coalesce(F.abs(F.lead(value).over(_order()) - F.col(value)), F.lit(0.0)) < threshold).cast("int")


def contact_features(frames: DataFrame, value: str = "value", threshold: float = 0.01) -> DataFrame:
    """Contacts by squared displacement, without the last frame."""
    d = F.lead(value).over(_order()) - F.col(value)
    return frames.withColumn("contact", (d * d < threshold).cast("int")).where("contact is not null")


def local_minima(frames: DataFrame, k: int = 1, value: str = "value", least: float | None = None) -> DataFrame:
    """Frames strictly below their k neighbours on both sides.

    Neighbours beyond the ends are clipped, which always leaves out the first and
    last frame.
    """
    low = F.least(F.min(value).over(_order().rowsBetween(-k, -1)), F.min(value).over(_order().rowsBetween(1, k)))
    edge = F.lag(value).over(_order()).isNull() | F.lead(value).over(_order()).isNull()
    x = frames.withColumn("_m", ~edge & (F.col(value) < low)).where("_m").drop("_m")
    return x if least is None else x.where(F.col(value) > least)


def envelope(value: str = "value", size: int = 1024) -> Column:
    """Largest |x| of the next `size` samples; null where fewer follow (see fill_tail)."""
    full = F.count("*").over(_order().rowsBetween(0, size - 1)) == size
    peak = F.max(F.abs(value)).over(_order().rowsBetween(0, size - 1))
    return F.when(full, peak)


def fill_tail(column: str) -> Column:
    """The last known value, for the frames at the end without one."""
    return F.coalesce(F.col(column), F.last(column, ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, 0)))


def fill_left(value: str = "value") -> Column:
    """Blanks take the nearest value to the left, around the end if need be."""
    left = F.last(value, ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(left, F.last(value, ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def gaussian(value: str = "value", sigma: float = 2.0) -> Column:
    """Smoothing with radius floor(4 sigma + 0.5); zeros beyond the ends."""
    import math

    radius = math.floor(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    total = sum(weights)
    terms = [F.coalesce(F.lag(value, -i).over(_order()), F.lit(0.0)) * (w / total) for i, w in zip(range(-radius, radius + 1), weights, strict=True)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def quaternion_continuity(frames: DataFrame) -> DataFrame:
    """Quaternions (array column q) with signs flipped to stay near the one before."""
    prior = F.lag("q").over(_order())
    dot = F.aggregate(F.zip_with("q", prior, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    flagged = frames.withColumn("_f", F.coalesce((dot < 0).cast("int"), F.lit(0)))
    flips = flagged.withColumn("_s", F.sum("_f").over(_order().rowsBetween(Window.unboundedPreceding, 0)) % 2)
    return flips.withColumn("q", F.when(F.col("_s") == 1, F.transform("q", lambda x: -x)).otherwise(F.col("q"))).drop("_f", "_s")


def run_numbers(mask: Column) -> Column:
    """The number of the run of ones a frame is in, from 1; null outside."""
    start = (mask == 1) & (F.coalesce(F.lag(mask).over(_order()), F.lit(0)) == 0)
    return F.when(mask == 1, F.sum(start.cast("int")).over(_order()))


def floor_height(value: str = "value") -> Column:
    return F.min(value).over(_whole())


def softmin_height(value: str = "value", softness: float = 0.5) -> Column:
    """A floor height a little below the smallest value of a sequence, softened by its range."""
    low, high = F.min(value).over(_whole()), F.max(value).over(_whole())
    return low - F.log(softness + F.exp(low - high))


def doubled(frames: DataFrame, value: str = "value") -> DataFrame:
    """Twice as many frames: each followed by the mean of it and the next, the last by itself."""
    after = (F.col(value) + F.coalesce(F.lead(value).over(_order()), F.col(value))) / 2
    both = F.array(F.struct((2 * F.col("frame")).alias("frame"), F.col(value).alias(value)), F.struct((2 * F.col("frame") + 1).alias("frame"), F.col("_after").alias(value)))
    return frames.withColumn("_after", after).select("seq_id", F.explode(both).alias("x")).select("seq_id", "x.*")


def blended(first: DataFrame, second: DataFrame, overlap: int, value: str = "value") -> DataFrame:
    """Two sequences as one: the last `overlap` frames of the first fade into the first of the second."""
    n = first.groupBy("seq_id").agg(F.max("frame").alias("last"))
    later = second.join(n, "seq_id").select("seq_id", (F.col("frame") + F.col("last") + 1 - overlap).alias("frame"), F.col(value).alias("_b"), ((F.col("frame") + 1) / (overlap + 1)).alias("_t"))
    x = first.select("seq_id", "frame", F.col(value).alias("_a")).join(later, ["seq_id", "frame"], "full")
    mixed = F.col("_a") * (1 - F.col("_t")) + F.col("_b") * F.col("_t")
    return x.select("seq_id", "frame", F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")).otherwise(mixed).alias(value))


def contact_steps(frames: DataFrame, value: str = "value", start: int = 1, least: float = 0.02, apart: int = 120) -> DataFrame:
    """(seq_id, frame, step): 1 from each peak on, 0 from each trough on, `start` before.

    Peaks are frames above `least` of the sequence's range that exceed all others
    within `apart` frames (of equal ones the first); troughs are peaks of -value.
    """
    near = _order().rangeBetween(-apart, apart)
    low, high = F.min(value).over(_whole()), F.max(value).over(_whole())
    x = frames.withColumns({"_lo": low, "_hi": high, "_top": F.max(F.struct(F.col(value).alias("v"), (-F.col("frame")).alias("f"))).over(near), "_bottom": F.min(F.struct(F.col(value).alias("v"), F.col("frame").alias("f"))).over(near)})
    up = (F.col("_top.f") == -F.col("frame")) & (F.col(value) - F.col("_lo") > least * (F.col("_hi") - F.col("_lo")))
    down = (F.col("_bottom.f") == F.col("frame")) & (F.col("_hi") - F.col(value) > least * (F.col("_hi") - F.col("_lo")))
    step = F.last(F.when(down, 0).when(up, 1), ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    return x.select("seq_id", "frame", F.coalesce(step, F.lit(start)).alias("step"))
