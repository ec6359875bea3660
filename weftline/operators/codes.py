"""Vector quantisation: nearest codes, codebook statistics and updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A codebook is a model parameter; larger ones than this are refused.
MOST_CODES = 65_536


def distance2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def nearest_code(vectors: DataFrame, codebook: DataFrame) -> DataFrame:
    """(vec_id, code, d2): the nearest code of each vector; ties take the lowest.

    `vectors` has vec_id and vec, `codebook` code and vec. The codebook, of a
    checked size, goes to every task, which sums squared differences for all codes.
    A vector that is null, holds nulls or has another width gets null.
    """
    rows = codebook.orderBy("code").limit(MOST_CODES + 1).collect()
    if len(rows) > MOST_CODES:
        raise ValueError(f"a codebook has {MOST_CODES} codes at most")
    codes = np.array([r.code for r in rows], np.int64)
    book = np.array([r.vec for r in rows], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                ok = np.asarray(batch.column("ok"))
                x = batch.column("vec").filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).reshape(int(ok.sum()), book.shape[-1])
                code, d2 = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
                if len(x):
                    rest = np.empty((len(x), len(book)))
                    for j in range(len(book)):  # differences, as sums of products would break ties
                        rest[:, j] = ((x - book[j]) ** 2).sum(1)
                    best = rest.argmin(1)
                    code[ok], d2[ok] = codes[best], rest[np.arange(len(x)), best]
                yield pa.record_batch({"vec_id": batch.column("vec_id"), "code": pa.array(code, mask=~ok), "d2": pa.array(d2, mask=~ok)})

    vec = F.col("vec").cast("array<double>")
    fits = F.coalesce((F.size(vec) == book.shape[-1]) & ~F.exists(vec, lambda v: v.isNull()), F.lit(False)) if len(book) else F.lit(False)
    return vectors.select(F.col("vec_id").cast("long"), vec.alias("vec"), fits.alias("ok")).mapInArrow(run, "vec_id long, code long, d2 double")


def perplexity(codes: DataFrame, eps: float = 1e-7) -> DataFrame:
    """(n_codes, perplexity) of the code histogram."""
    h = codes.groupBy("code").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy())
    return h.select(p.alias("p")).agg(F.count("*").alias("n_codes"), F.exp(-F.sum(F.col("p") * F.log(F.col("p") + eps))).alias("perplexity"))


def code_sums(assigned: DataFrame) -> DataFrame:
    """(code, i, n, total): per code and component, from (code, vec)."""
    return assigned.select("code", F.posexplode(F.col("vec").cast("array<double>")).alias("i", "x")).groupBy("code", "i").agg(F.count("*").alias("n"), F.sum("x").alias("total"))


def ema_update(codebook: DataFrame, assigned: DataFrame, mu: float = 0.99, least: float = 1.0) -> DataFrame:
    """(code, i, count, total, value, is_replaced): decayed counts and sums.

    `codebook` is long: code, i, count, total, value. Codes whose decayed count
    falls below `least` are marked for replacement and keep their value.
    """
    new = code_sums(assigned).withColumnRenamed("total", "t2")
    x = codebook.join(new, ["code", "i"], "left")
    count = mu * F.col("count") + (1 - mu) * F.coalesce("n", F.lit(0))
    total = mu * F.col("total") + (1 - mu) * F.coalesce("t2", F.lit(0.0))
    return x.select("code", "i", count.alias("count"), total.alias("total"), F.when(count >= least, total / count).otherwise(F.col("value")).alias("value"), (count < least).alias("is_replaced"))


def smoothed_counts(counts: DataFrame, eps: float = 1e-5) -> DataFrame:
    """Laplace smoothing (c + eps) / (n + K eps) * n over all codes."""
    whole = Window.partitionBy()
    n, k = F.sum("count").over(whole), F.count("*").over(whole)
    return counts.select("code", ((F.col("count") + eps) / (n + k * eps) * n).alias("smoothed"))


def look_up(codes: DataFrame, codebook: DataFrame) -> DataFrame:
    return codes.join(codebook.select("code", F.col("vec").alias("code_vec")), "code")


def sign_bits(vec: Column) -> Column:
    """sign(x) / sqrt(width) of a vector; its length does not matter, and zero counts as -."""
    return F.transform(vec, lambda x: F.when(x > 0, 1.0).otherwise(-1.0) / F.sqrt(F.size(vec).cast("double")))


def bit_code(vec: Column, width: int) -> Column:
    """The integer of the first `width` sign bits."""
    return F.aggregate(F.slice(vec, 1, width), F.lit(0).cast("long"), lambda s, x: s * 2 + F.when(x > 0, 1).otherwise(0))


def scale_bits(frames: DataFrame, scales: list[int]) -> DataFrame:
    """(seq_id, level, place, bits): residual sign bits of sequences at rising scales.

    `frames` has seq_id, frame and vec, at least one frame a sequence. At each scale the
    residual is averaged over that many areas, quantised by signs, and stretched
    linearly back over all frames; what is left goes to the next scale. A sequence is
    one group, as all scales need all its frames.
    """
    kind = frames.schema["seq_id"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("frame")
        x = group.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
        n, width = x.shape
        out: dict[str, list] = {"seq_id": [], "level": [], "place": [], "bits": []}
        for level, scale in enumerate(scales):
            low = np.arange(scale) * n // scale
            high = -(-(np.arange(scale) + 1) * n // scale)
            sums = np.concatenate((np.zeros((1, width)), np.cumsum(x, 0)))
            area = (sums[high] - sums[low]) / (high - low)[:, None]
            bits = area > 0
            signs = np.where(bits, 1.0, -1.0) / np.sqrt(width)
            at = np.clip((np.arange(n) + 0.5) * scale / n - 0.5, 0, scale - 1)
            left = np.floor(at).astype(int)
            right, t = np.minimum(left + 1, scale - 1), (at - left)[:, None]
            x = x - (signs[left] * (1 - t) + signs[right] * t)
            for i in range(scale):
                out["seq_id"].append(group.column("seq_id")[0].as_py())
                out["level"].append(level)
                out["place"].append(i)
                out["bits"].append("".join("1" if b else "0" for b in bits[i]))
        return pa.table({"seq_id": pa.array(out["seq_id"], group.schema.field("seq_id").type), "level": pa.array(out["level"], pa.int32()), "place": pa.array(out["place"], pa.int32()), "bits": pa.array(out["bits"])})

    return frames.select("seq_id", "frame", F.col("vec").cast("array<double>")).groupBy("seq_id").applyInArrow(run, f"seq_id {kind}, level int, place int, bits string")


def replaced(updated: DataFrame, vectors: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of ema_update with the values of codes marked for replacement taken from data.

    The r-th of them (in order of code) takes the r-th vector (vec_id, vec) of a hashed
    order, from the first again if there are fewer vectors than codes.
    """
    dead = updated.where("is_replaced").select("code").distinct()
    dead = dead.withColumn("r", F.row_number().over(Window.orderBy("code")) - 1)  # codes of one codebook
    draw = vectors.select(F.md5(F.concat(F.col("vec_id").cast("string"), F.lit(f":{seed}"))).alias("h"), "vec_id", "vec").orderBy("h", "vec_id").limit(MOST_CODES)
    draw = draw.withColumn("k", F.row_number().over(Window.orderBy("h", "vec_id")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    size = draw.agg(F.max("n").alias("n"))
    picks = dead.join(F.broadcast(size), F.lit(True)).withColumn("k", F.pmod("r", "n"))  # one row
    new = picks.join(draw.select("k", F.posexplode(F.col("vec").cast("array<double>")).alias("i", "fresh")), "k").select("code", "i", "fresh")
    return updated.join(new, ["code", "i"], "left").select("code", "i", "count", "total", F.coalesce("fresh", "value").alias("value"), "is_replaced")
