"""Per-dimension statistics, masks and batches of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def channel_statistics(vectors: DataFrame) -> DataFrame:
    """(i, mean, std, variance, low, high, n) of each component of `vec`; population std, sample variance."""
    x = vectors.select(F.posexplode(F.col("vec").cast("array<double>")).alias("i", "x"))
    return x.groupBy("i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.var_samp("x").alias("variance"), F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))


def standardize(vectors: DataFrame, stats: DataFrame, inverse: bool = False) -> DataFrame:
    """(x - mean) / std per component, or back; a zero std counts as one."""
    row = stats.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean", "std"))), lambda s: F.struct(s["mean"].alias("m"), F.when(s["std"] == 0, 1.0).otherwise(s["std"]).alias("s"))).alias("_s"))
    change = (lambda x, s: x * s["s"] + s["m"]) if inverse else (lambda x, s: (x - s["m"]) / s["s"])
    return vectors.crossJoin(F.broadcast(row)).withColumn("vec", F.zip_with(F.col("vec").cast("array<double>"), "_s", change)).drop("_s")  # one row of a vector's width


def constant_channels(stats: DataFrame, least: float = 1e-9) -> DataFrame:
    return stats.where(F.col("std") < least).select("i")


def mask_select(vec: Column, mask: list[int]) -> Column:
    """The components whose mask is 1."""
    keep = [i for i, m in enumerate(mask) if m]
    return F.transform(F.array(*[F.lit(i) for i in keep]), lambda i: F.get(vec, i))


def mask_scatter(vec: Column, mask: list[int]) -> Column:
    """The inverse of mask_select: zeros where the mask is 0."""
    place, at = [], 0
    for m in mask:
        place.append(at if m else -1)
        at += bool(m)
    return F.transform(F.array(*[F.lit(p) for p in place]), lambda p: F.when(p < 0, 0.0).otherwise(F.get(vec, F.greatest(p, F.lit(0)))))


def fit_width(vec: Column, width: int) -> Column:
    """Zero padded or cut to a width."""
    return F.slice(F.concat(vec, F.array_repeat(F.lit(0.0), width)), 1, width)


def has_signal(vec: Column) -> Column:
    return (F.size(vec) > 0) & F.exists(vec, lambda x: x != 0)


def pad_batches(rows: DataFrame, batch: str, column: str) -> DataFrame:
    """Arrays padded with zeros to the longest of their batch, with the length."""
    most = F.max(F.size(column)).over(Window.partitionBy(batch))
    return rows.withColumn("length", F.size(column)).withColumn("_m", most).withColumn(column, F.concat(F.col(column).cast("array<double>"), F.array_repeat(F.lit(0.0), F.col("_m") - F.col("length")))).drop("_m")


def pad_nested(rows: DataFrame, batch: str, column: str, depth: int) -> DataFrame:
    """Arrays of `depth` levels padded with zeros to their batch's size in every dimension.

    `sizes` has each row's own size by level. Null arrays at any level are empty ones; the
    largest sizes are an aggregate of one row a batch and level.
    """

    def size(x: Column, level: int) -> Column:
        if level == 0:
            return F.coalesce(F.when(x.isNotNull(), F.size(x)), F.lit(0))
        return F.coalesce(F.array_max(F.transform(x, lambda y: size(y, level - 1))), F.lit(0))

    def zeros(level: int) -> Column:
        return F.lit(0.0) if level == depth else F.array_repeat(zeros(level + 1), F.get("_most", level))

    def pad(x: Column, level: int) -> Column:
        kind = "array<" * (depth - level) + "double" + ">" * (depth - level)
        x = F.coalesce(x.cast(kind), F.array().cast(kind))
        inner = x if level == depth - 1 else F.transform(x, lambda y: pad(y, level + 1))
        return F.concat(inner, F.array_repeat(zeros(level + 1), F.get("_most", level) - F.size(x)))

    x = rows.withColumn("sizes", F.array(*[size(F.col(column), k) for k in range(depth)]))
    most = F.array(*[F.max(F.get("sizes", k)).over(Window.partitionBy(batch)) for k in range(depth)])
    return x.withColumn("_most", most).withColumn(column, pad(F.col(column), 0)).drop("_most")


def unpad(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, F.slice(column, 1, F.col("length")))


def collate(rows: DataFrame, batch: str, order: str, columns: list[str]) -> DataFrame:
    """One row a batch with an array of records, in order."""
    item = F.struct(F.col(order), *[F.col(c) for c in columns])
    return rows.groupBy(batch).agg(F.array_sort(F.collect_list(item)).alias("records"))


def resize_linear(vec: Column, size: int) -> Column:
    """Linear interpolation of an array to `size` values, ends kept."""
    n = F.size(vec)
    step = (n - 1) / F.lit(float(max(size - 1, 1)))

    def at(i: Column) -> Column:
        p = i * step
        a = F.floor(p).cast("int")
        b = F.least(a + 1, n - 1)
        return F.get(vec, a) * (1 - (p - a)) + F.get(vec, b) * (p - a)

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1)."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.try_divide(w * h, area(a) + area(b) - w * h)


def huber(d: Column, beta: float = 1.0) -> Column:
    x = F.abs(d)
    return F.when(x < beta, 0.5 * x * x / beta).otherwise(x - 0.5 * beta)


def mask_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two 0/1 arrays of one length; 0 if both are empty."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)
    both = total(F.zip_with(a, b, lambda x, y: ((x > 0) & (y > 0)).cast("int")))
    any_ = total(F.zip_with(a, b, lambda x, y: ((x > 0) | (y > 0)).cast("int")))
    return F.coalesce(F.try_divide(both, any_), F.lit(0.0))


def kl_normal(mean: Column, log_variance: Column) -> Column:
    """KL divergence of a normal distribution from the standard one, a term of the sum."""
    return -0.5 * (1 + log_variance - mean * mean - F.exp(log_variance))


def cross_entropy(p: Column, truth: Column, eps: float = 1e-12) -> Column:
    """Binary cross entropy of a chance and a 0/1 truth."""
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return -(truth * F.log(q) + (1 - truth) * F.log(1 - q))


def renormalize(vectors: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors standardised by one set of statistics, by another one instead."""
    return standardize(standardize(vectors, old, inverse=True), new)
