"""Evaluation metrics as aggregates over sequences, pairs and groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.corpus import hash_order
from weftline.operators.shared import stored


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def joint_errors(pairs: DataFrame, joints: int, root: int = 0, scale: float = 1000.0) -> DataFrame:
    """(seq_id, frame, mpjpe): mean joint distance after taking off the root.

    `pairs` has seq_id, frame and two flat arrays pred and truth of 3 * joints.
    Joints whose true x is -2 are missing and do not count.
    """
    at = lambda c, j, k: F.get(F.col(c), j * 3 + k) - F.get(F.col(c), root * 3 + k)
    d = F.transform(F.sequence(F.lit(0), F.lit(joints - 1)), lambda j: F.when(F.get("truth", j * 3) == -2, F.lit(None)).otherwise(F.sqrt(sum((at("pred", j, k) - at("truth", j, k)) ** 2 for k in range(3)))))
    ok = F.filter(d, lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(ok, F.lit(0.0), lambda s, x: s + x), F.size(ok))
    return pairs.select("seq_id", "frame", (mean * scale).alias("mpjpe"))


def sequence_mean(frames: DataFrame, value: str) -> DataFrame:
    """The mean over sequences of the mean over their frames."""
    return frames.groupBy("seq_id").agg(F.avg(value).alias("_m")).agg(F.avg("_m").alias(value), F.count("*").alias("n_sequences"))


def acceleration_error(pairs: DataFrame) -> DataFrame:
    """(seq_id, accel): mean |second difference of pred - that of truth|.

    `pairs` has seq_id, frame, pred and truth (doubles).
    """
    order = Window.partitionBy("seq_id").orderBy("frame")
    second = lambda c: F.lead(c).over(order) - 2 * F.col(c) + F.lag(c).over(order)
    x = pairs.select("seq_id", F.abs(second("pred") - second("truth")).alias("d")).where("d is not null")
    return x.groupBy("seq_id").agg(F.avg("d").alias("accel"))


def root_errors(pairs: DataFrame) -> DataFrame:
    """Mean |dx|, |dy|, |dz| and distance, each a mean of sequence means.

    `pairs` has seq_id, frame, and px, py, pz, tx, ty, tz.
    """
    d = [F.col(f"p{c}") - F.col(f"t{c}") for c in "xyz"]
    per = pairs.groupBy("seq_id").agg(*[F.avg(F.abs(x)).alias(f"err_{c}") for x, c in zip(d, "xyz", strict=True)], F.avg(F.sqrt(d[0] ** 2 + d[1] ** 2 + d[2] ** 2)).alias("err"))
    return per.agg(*[F.avg(c).alias(c) for c in ("err_x", "err_y", "err_z", "err")])


def lip_error(vertices: DataFrame) -> DataFrame:
    """(lve, mod): sums over frames of the largest and the mean error, by frames.

    `vertices` has seq_id, frame, vertex and err.
    """
    per = vertices.groupBy("seq_id", "frame").agg(F.max("err").alias("m"), F.avg("err").alias("a"))
    return per.agg((F.sum("m") / F.count("*")).alias("lve"), (F.sum("a") / F.count("*")).alias("mod"), F.count("*").alias("n_frames"))


def dynamics_deviation(vertices: DataFrame) -> DataFrame:
    """(seq_id, fdd): mean over vertices of std(truth) - std(pred) over time."""
    per = vertices.groupBy("seq_id", "vertex").agg((F.stddev_pop("truth") - F.stddev_pop("pred")).alias("d"))
    return per.groupBy("seq_id").agg(F.avg("d").alias("fdd"))


def l1_diversity(values: DataFrame) -> DataFrame:
    """Sum of |x - mean over time| by frames; (seq_id, frame, dim, value)."""
    x = values.withColumn("m", F.avg("value").over(Window.partitionBy("seq_id", "dim")))
    per = x.groupBy("seq_id", "frame").agg(F.sum(F.abs(F.col("value") - F.col("m"))).alias("d"))
    return per.agg((F.sum("d") / F.count("*")).alias("l1_div"))


def gesture_recall(frames: DataFrame, threshold: float = 0.1, scale: float = 0.165) -> DataFrame:
    """Mean success (|pred - truth| < threshold) weighted by semantic / scale."""
    hit = (F.abs(F.col("pred") - F.col("truth")) < threshold).cast("double")
    return frames.agg((F.sum(hit * F.col("semantic") / scale) / F.count("*")).alias("srgr"), F.count("*").alias("n_frames"))


def weighted_means(values: DataFrame, columns: list[str], weight: str) -> DataFrame:
    return values.agg(*[(F.sum(F.col(c) * F.col(weight)) / F.sum(weight)).alias(c) for c in columns])


def geodesic(a: Column, b: Column) -> Column:
    """Angle between two rotation matrices (flat arrays of 9)."""
    trace = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.acos(F.greatest(F.least((trace - 1) / 2, F.lit(1.0)), F.lit(-1.0)))


def diversity(vectors: DataFrame, size: int, seeds: tuple[int, int] = (1, 2), group: str | None = None) -> DataFrame:
    """Mean distance of two random sets of `size` vectors, paired by rank.

    `vectors` has vec_id and vec. With a group, one row per group (the label-wise
    multimodality); the sets come from two hashed orders and a bounded limit.
    """
    keys = [group] if group else []

    def sample(seed: int, name: str) -> DataFrame:
        h = vectors.select(*keys, "vec_id", F.col("vec").alias(name)).withColumn("_h", hash_order(F.col("vec_id"), seed))
        if not group:
            h = h.orderBy("_h", "vec_id").limit(size)  # a partial top list in each task
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "vec_id"))
        return h.withColumn("k", rank).where(F.col("k") <= size).select(*keys, "k", name)

    pairs = sample(seeds[0], "a").join(sample(seeds[1], "b"), [*keys, "k"])
    return pairs.groupBy(*keys).agg(F.avg(distance(F.col("a"), F.col("b"))).alias("diversity"), F.count("*").alias("n_pairs"))


def retrieval(queries: DataFrame, items: DataFrame, group_size: int, most: int = 3) -> DataFrame:
    """R-precision at 1..most and the matching score, inside groups of rows.

    Both have row and vec; row i of the one matches row i of the other, among
    the `group_size` rows of its group.
    """
    g = lambda c: F.floor(F.col(c) / group_size)
    q = queries.select(F.col("row").alias("q"), F.col("vec").alias("a"), g("row").alias("g"))
    i = items.select(F.col("row").alias("i"), F.col("vec").alias("b"), g("row").alias("g"))
    d = q.join(i, "g").withColumn("d", distance(F.col("a"), F.col("b")))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "i"))
    own = d.withColumn("rank", rank).where("q = i")
    return own.agg(F.avg("d").alias("matching"), *[F.avg((F.col("rank") <= k).cast("double")).alias(f"top{k}") for k in range(1, most + 1)], F.count("*").alias("n"))


def moment_sums(vectors: DataFrame) -> DataFrame:
    """(d, i, x): number, sums and Gram matrix of vectors of each length d, one after the other.

    Vectors that are null, empty or hold a null or non-finite component are left out. A task
    sends one Gram matrix a length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            column = batch.column(0)
            sizes = np.diff(np.asarray(column.offsets))
            for d in np.unique(sizes).tolist():
                x = column.filter(pa.array(sizes == d)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                sums[d] = np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel())) + sums.get(d, 0)
        for d, flat in sums.items():
            yield pa.record_batch({"d": pa.array(np.full(len(flat), d), pa.int64()), "i": pa.array(np.arange(len(flat)), pa.int64()), "x": flat})

    ok = (F.size("vec") > 0) & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    parts = vectors.where(F.coalesce(ok, F.lit(False))).select(F.col("vec").cast("array<double>")).mapInArrow(run, "d long, i long, x double")
    return parts.groupBy("d", "i").agg(F.sum("x").alias("x"))


def _moments_of(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    d = int((np.sqrt(4 * len(flat) - 3) - 1) / 2)
    n, mean, gram = flat[0], flat[1 : d + 1] / flat[0], flat[d + 1 :].reshape(d, d)
    return mean, (gram - n * np.outer(mean, mean)) / max(n - 1, 1), int(n)


def moments(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and sample covariance (see moment_sums) of the vectors of the length that most have.

    Of two such lengths, the longer counts.
    """
    sums = moment_sums(vectors)
    most = sums.where("i = 0").orderBy(F.desc("x"), F.desc("d")).first()
    if most is None:
        return np.zeros(0), np.zeros((0, 0)), 0
    return _moments_of(np.array([r.x for r in sums.where(F.col("d") == most.d).orderBy("i").collect()]))  # 1 + d + d*d numbers


def _frechet_of(one: tuple, two: tuple, eps: float) -> float:
    """The distance of two normal distributions; near-singular covariances get eps on the diagonal."""

    def middle(c1: np.ndarray, c2: np.ndarray) -> float:
        w, v = np.linalg.eigh(c1)
        root = (v * np.sqrt(np.maximum(w, 0))) @ v.T
        return float(np.sqrt(np.maximum(np.linalg.eigvalsh(root @ c2 @ root), 0)).sum())

    (m1, c1, _), (m2, c2, _) = one, two
    try:
        trace = middle(c1, c2)
    except np.linalg.LinAlgError:
        trace = float("nan")
    if not np.isfinite(trace):
        offset = eps * np.eye(len(c1))
        trace = middle(c1 + offset, c2 + offset)
    return float(((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * trace)


def frechet_distance(a: DataFrame, b: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(frechet): one row with the Frechet distance of two sets of vectors, as a lazy plan.

    Both sides' sums are aggregates of 1 + d + d * d numbers; the last step is on d x d
    matrices of the length that most vectors of both sides have. Null without two sides.
    """

    def last(rows: pa.Table) -> pa.Table:
        side, d, i, x = (rows.column(c).to_numpy() for c in ("side", "d", "i", "x"))
        sizes = {int(k): x[(d == k) & (i == 0)].sum() for k in np.unique(d) if len(np.unique(side[d == k])) == 2}
        if not sizes:
            return pa.table({"frechet": pa.array([None], pa.float64())})
        k = max(sizes, key=lambda k: (sizes[k], k))
        own = [(d == k) & (side == s) for s in (0, 1)]
        return pa.table({"frechet": [_frechet_of(*[_moments_of(x[m][np.argsort(i[m])]) for m in own], eps)]})

    both = moment_sums(a).withColumn("side", F.lit(0)).union(moment_sums(b).withColumn("side", F.lit(1)))
    return both.groupBy().applyInArrow(last, "frechet double")


def frechet(a: DataFrame, b: DataFrame) -> float:
    """Frechet distance of two sets of vectors as a number."""
    return frechet_distance(a, b).first().frechet


def leaning_clips(angles: DataFrame, top: float = 30.0, mean: float = 20.0) -> DataFrame:
    """(clip, top, mean): clips whose spine angles (clip, angle, in degrees) exceed a limit at once or on average."""
    x = angles.groupBy("clip").agg(F.max("angle").alias("top"), F.avg("angle").alias("mean"))
    return x.where((F.col("top") > top) | (F.col("mean") > mean))


def up_angle(direction: Column, axis: int = 1) -> Column:
    """The angle in degrees of a direction, up or down, to an axis."""
    share = F.abs(F.get(direction, axis)) / norm(direction)
    return F.degrees(F.acos(F.greatest(F.least(share, F.lit(1.0)), F.lit(-1.0))))


def covariance(vectors: DataFrame, dims: int) -> DataFrame:
    """(i, j, cov) of the first `dims` components, i <= j, in SQL aggregates."""
    v = vectors.select(*[F.get("vec", k).cast("double").alias(f"c{k}") for k in range(dims)])
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    row = v.agg(*[F.covar_samp(f"c{i}", f"c{j}").alias(f"{i}_{j}") for i, j in pairs])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"{i}_{j}").alias("cov")) for i, j in pairs])
    return row.select(F.explode(cells).alias("x")).select("x.*")


def subsets(vectors: DataFrame, n_subsets: int, size: int, seed: int = 42) -> DataFrame:
    """(subset, vec_id, vec): for each subset, `size` vectors drawn from all of them.

    The first of a hashed order of (vec_id, subset), in one scan: each task keeps its own
    first ones of every subset. The draws are stored, as pairs of them are formed repeatedly.
    """
    x = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(n_subsets - 1))).alias("subset"), "vec_id", "vec")
    x = x.withColumn("_h", F.md5(F.concat(F.col("vec_id").cast("string"), F.lit(":"), (F.col("subset") + seed).cast("string"))))
    rank = F.row_number().over(Window.partitionBy("subset").orderBy("_h", "vec_id"))
    return stored(x.withColumn("_k", rank).where(F.col("_k") <= size).select("subset", "vec_id", "vec"))


def kernel_distance(a: DataFrame, b: DataFrame, degree: int = 3) -> DataFrame:
    """(subset, mmd2, variance): unbiased squared MMD with a polynomial kernel, and the
    estimate of its variance.

    Both have subset, vec_id and vec; subsets are samples of equal, bounded size m, so
    the pairs of a subset are bounded. All sums run over the kernel's rows.
    """
    k = lambda x, y, d: F.pow(F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v) / d + 1, F.lit(float(degree)))

    def rows(x: DataFrame, y: DataFrame, name: str, apart: bool) -> DataFrame:
        """Per row of x its sum of kernel values with y, and of their squares."""
        p = x.select("subset", F.col("vec_id").alias("i"), F.col("vec").alias("u")).join(y.select("subset", F.col("vec_id").alias("j"), F.col("vec").alias("v")), "subset")
        p = (p.where("i <> j") if apart else p).withColumn("k", k(F.col("u"), F.col("v"), F.size("u")))
        return p.groupBy("subset", "i").agg(F.sum("k").alias(name), F.sum(F.col("k") * F.col("k")).alias(f"{name}2"))

    both = rows(a, a, "x", True).join(rows(a, b, "c", False), ["subset", "i"])
    mine = both.groupBy("subset").agg(F.count("*").alias("m"), *[F.sum(c).alias(c) for c in ("x", "x2", "c", "c2")], F.sum(F.col("x") * F.col("x")).alias("xs"), F.sum(F.col("c") * F.col("c")).alias("cs1"), F.sum(F.col("x") * F.col("c")).alias("xc"))
    other = rows(b, b, "y", True).join(rows(b, a, "d", False), ["subset", "i"])
    theirs = other.groupBy("subset").agg(*[F.sum(c).alias(c) for c in ("y", "y2")], F.sum(F.col("y") * F.col("y")).alias("ys"), F.sum(F.col("d") * F.col("d")).alias("cs0"), F.sum(F.col("y") * F.col("d")).alias("yd"))
    s = mine.join(theirs, "subset").withColumn("m", F.col("m").cast("double"))
    m, x, y, c = (F.col(v) for v in "mxyc")
    m1, m2 = m - 1, m - 2
    alone = (x * x + y * y) / (m * m1) / (m * m1)
    crossed = (F.col("xc") + F.col("yd")) / (m * m * m1)
    mixed = (x + y) * c / (m * m * m * m1)
    zeta1 = (F.col("xs") - F.col("x2") + F.col("ys") - F.col("y2")) / (m * m1 * m2) - alone + (F.col("cs1") + F.col("cs0") - 2 * F.col("c2")) / (m * m * m1) - 2 * c * c / (m * m * m * m) - 2 * crossed + 2 * mixed
    zeta2 = (F.col("x2") + F.col("y2")) / (m * m1) - alone + 2 * F.col("c2") / (m * m) - 2 * c * c / (m * m * m * m) - 4 * crossed + 4 * mixed
    mmd2 = (x + y) / (m * m1) - 2 * c / (m * m)
    return s.select("subset", mmd2.alias("mmd2"), (4 * m2 / (m * m1) * zeta1 + 2 / (m * m1) * zeta2).alias("variance"))


def procrustes_errors(pairs: DataFrame, scale: float = 1000.0) -> DataFrame:
    """(seq_id, frame, pa_mpjpe): mean joint distance after the best similarity.

    `pairs` has seq_id, frame and flat arrays pred and truth; the small singular
    value decompositions of a batch run at once. Rows with a null array are left out.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shape = (batch.num_rows, -1, 3)
            p, t = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(shape) for c in ("pred", "truth"))
            p0, t0 = p - p.mean(1, keepdims=True), t - t.mean(1, keepdims=True)
            u, s, vt = np.linalg.svd(p0.transpose(0, 2, 1) @ t0)
            sign = np.sign(np.linalg.det(u @ vt))
            s = s * np.stack((np.ones(len(s)), np.ones(len(s)), sign), 1)
            flip = np.stack((np.ones(len(s)), np.ones(len(s)), sign), 1)[:, :, None]
            rotation = u @ (flip * vt)
            size = s.sum(1) / np.maximum((p0 * p0).sum((1, 2)), 1e-300)
            error = np.linalg.norm(size[:, None, None] * (p0 @ rotation) - t0, axis=2).mean(1)
            yield pa.record_batch({"seq_id": batch.column("seq_id"), "frame": batch.column("frame"), "pa_mpjpe": error * scale})

    x = pairs.where("pred is not null and truth is not null").select("seq_id", "frame", F.col("pred").cast("array<double>"), F.col("truth").cast("array<double>"))
    return x.mapInArrow(run, f"seq_id {kinds['seq_id']}, frame {kinds['frame']}, pa_mpjpe double")


def static_clips(clips: DataFrame, threshold: float = 0.0014) -> DataFrame:
    """Clips in which both joints hardly move: summed variances below a threshold.

    `clips` has clip, frame and two arrays a and b.
    """
    x = clips.select("clip", F.posexplode(F.concat("a", "b")).alias("i", "v"), F.size("a").alias("na"))
    per = x.groupBy("clip", "i").agg(F.var_pop("v").alias("s"), F.first("na").alias("na"))
    both = per.groupBy("clip").agg(F.sum(F.when(F.col("i") < F.col("na"), F.col("s"))).alias("sa"), F.sum(F.when(F.col("i") >= F.col("na"), F.col("s"))).alias("sb"))
    return both.where((F.col("sa") < threshold) & (F.col("sb") < threshold)).select("clip")


def soft_entropy(vectors: DataFrame, inverse_temperature: float = 100.0) -> DataFrame:
    """(per_sample, codebook): mean bit entropy, and entropy of the mean bits.

    The chance of a bit is the sigmoid of -4 v / sqrt(width) by the inverse temperature.
    """
    h = lambda p: -(p * F.log(p + 1e-8) + (1 - p) * F.log(1 - p + 1e-8))
    x = vectors.select("vec_id", F.size("vec").cast("double").alias("width"), F.posexplode("vec").alias("i", "v"))
    x = x.withColumn("p", 1 / (1 + F.exp(4 * F.col("v") / F.sqrt("width") * inverse_temperature)))
    per = x.groupBy("vec_id").agg(F.sum(h(F.col("p"))).alias("s")).agg(F.avg("s").alias("per_sample"))
    whole = x.groupBy("i").agg(F.avg("p").alias("p")).agg(F.sum(h(F.col("p"))).alias("codebook"))
    return per.crossJoin(whole)  # one row each


def vertex_error(pairs: DataFrame) -> DataFrame:
    """(seq_id, mpvpe): mean distance of points pred and truth (arrays of 3) over frames and vertices."""
    return pairs.groupBy("seq_id").agg(F.avg(distance(F.col("pred"), F.col("truth"))).alias("mpvpe"))


def loss_means(updates: DataFrame, losses: list[str]) -> DataFrame:
    """Each loss summed over the updates, by their number, and the total of these."""
    out = updates.agg(*[(F.sum(c) / F.count("*")).alias(c) for c in losses])
    return out.withColumn("total", sum((F.col(c) for c in losses[1:]), F.col(losses[0])))


def block_distances(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """(group, i, j, d): Euclidean distances inside groups; not-a-number counts as 0.

    Both have the group, vec_id and vec. Groups are batches of a bounded size.
    """
    x = a.select(group, F.col("vec_id").alias("i"), F.col("vec").alias("u")).join(b.select(group, F.col("vec_id").alias("j"), F.col("vec").alias("v")), group)
    return x.select(group, "i", "j", F.nanvl(distance(F.col("u"), F.col("v")), F.lit(0.0)).alias("d"))


def variance_to(values: Column, length: Column) -> Column:
    """The unbiased variance of the first `length` entries of an array."""
    x = F.slice(values, 1, length)
    n = F.size(x)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    mean = total(x) / n
    return F.try_divide(total(F.transform(x, lambda v: (v - mean) * (v - mean))), n - 1)


def label_quota(vectors: DataFrame, quota: int, seed: int = 42) -> DataFrame:
    """(label, k, vec): `quota` vectors of every label by a hashed order, from all of them."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy(hash_order(F.col("vec_id"), seed), "vec_id"))
    return vectors.select("label", "vec_id", "vec", rank.alias("k")).where(F.col("k") <= quota)


def label_multimodality(vectors: DataFrame, quota: int, seeds: tuple[int, int] = (1, 2)) -> DataFrame:
    """(multimodality, n_labels): mean distance of two samples of each label, then over labels that fill the quota."""
    a, b = (label_quota(vectors, quota, s) for s in seeds)
    pairs = a.select("label", "k", F.col("vec").alias("u")).join(b.select("label", "k", F.col("vec").alias("v")), ["label", "k"])
    per = pairs.groupBy("label").agg(F.avg(distance(F.col("u"), F.col("v"))).alias("d"), F.count("*").alias("n")).where(F.col("n") == quota)
    return per.agg(F.avg("d").alias("multimodality"), F.count("*").alias("n_labels"))


def _spectrum(n_fft: int, hop: int, window: int):
    """The norm of a clip's short-time spectrum: frames around every hop-th sample, ends mirrored."""
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
    left = (n_fft - window) // 2
    weights = np.pad(hann, (left, n_fft - window - left))

    def norm(x: np.ndarray) -> float:
        if not len(x):
            return 0.0
        padded = np.pad(x, n_fft // 2, mode="reflect" if len(x) > 1 else "edge")
        frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop]
        total = 0.0
        for i in range(0, len(frames), 4096):
            total += float((np.abs(np.fft.rfft(frames[i : i + 4096] * weights, axis=1)) ** 2).sum())
        return float(np.sqrt(total))

    return norm


def audio_statistics(clips: DataFrame, n_fft: int = 2048, hop: int = 256, window: int = 1200, channels: int = 1, key: str | None = None) -> DataFrame:
    """(n_clips, n_seen, l1, l2, spec), of all clips or by key: what a corpus of audio is like.

    `clips` has samples, an array with the channels of each moment side by side. l1 is the mean
    of absolute samples, l2 the variance of samples, spec the mean over clips of the norm of the
    short-time Fourier transform of the channels' mean (frames of `n_fft` under a Hann window
    of `window`, every `hop` samples, centred). Each task adds up partial sums from Arrow
    batches. Null clips and clips with null samples are left out; what is left over from
    whole moments does not enter the spectrum.
    """
    norm = _spectrum(n_fft, hop, window)
    by = [key] if key else []
    kind = f"{key} {clips.schema[key].dataType.simpleString()}, " if key else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cell in batch.column("samples"):
                x = cell.values.to_numpy(zero_copy_only=False)
                mono = x[: len(x) // channels * channels].reshape(-1, channels).mean(1)
                rows.append((len(x), float(np.abs(x).sum()), float(x.sum()), float((x * x).sum()), norm(mono)))
            n, *sums = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.record_batch({**({key: batch.column(key)} if key else {}), "n": pa.array(n, pa.int64()), **{c: pa.array(v, pa.float64()) for c, v in zip(("a", "s", "q", "f"), sums, strict=True)}})

    usable = F.col("samples").isNotNull() & ~F.exists("samples", lambda v: v.isNull())
    x = clips.where(usable).select(*by, F.col("samples").cast("array<double>")).mapInArrow(run, f"{kind}n long, a double, s double, q double, f double")
    n = F.sum("n")
    sums = [F.count("*").alias("n_clips"), n.alias("n_seen"), F.try_divide(F.sum("a"), n).alias("l1"), (F.try_divide(F.sum("q"), n) - F.pow(F.try_divide(F.sum("s"), n), F.lit(2.0))).alias("l2"), F.avg("f").alias("spec")]
    return x.groupBy(*by).agg(*sums) if by else x.agg(*sums)


def chunk_statistics(chunks: DataFrame, sizes: dict[str, float]) -> DataFrame:
    """Totals over a corpus of chunks (bytes, seconds): chunks, mean bytes, bits a second, and
    for each named rate the share of it that is used."""
    rate = F.sum("bytes") * 8 / F.sum("seconds")
    return chunks.agg(F.count("*").alias("n_chunks"), F.avg("bytes").alias("mean_bytes"), rate.alias("bits_per_second"), *[(rate / v).alias(k) for k, v in sizes.items()])
