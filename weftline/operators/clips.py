"""Fixed windows over sequences: clips, segments, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _starts(frame: DataFrame, count: Column, stride: int, keep: list) -> DataFrame:
    """One row per window; sequences without any give none."""
    return frame.withColumn("_n", count).where("_n > 0").select(*keep, F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)).alias("clip")).withColumn("start", F.col("clip") * stride)


def clip_slices(sequences: DataFrame, fps: int = 25, length: int = 64, stride: int = 20, train: bool = True) -> DataFrame:
    """(seq_id, clip, start, stop) of a sequence of n frames.

    The sequence is first cut to whole seconds (one second at least). Training
    clips have a fixed length and stride, others are the whole sequence.
    """
    whole = F.when(F.col("n") < fps, fps).otherwise(F.floor(F.col("n") / fps) * fps)
    x = sequences.select("seq_id", whole.cast("int").alias("L"))
    if not train:
        return x.select("seq_id", F.lit(0).alias("clip"), F.lit(0).alias("start"), F.col("L").alias("stop"))
    return _starts(x, F.floor((F.col("L") - length) / stride) + 1, stride, ["seq_id"]).withColumn("stop", F.col("start") + length)


def segments_or_whole(sequences: DataFrame, most: int = 500, stride: int = 250) -> DataFrame:
    """Segments of `most` frames of longer sequences; shorter ones stay whole."""
    long_ = F.col("n") > most
    count = F.when(long_, F.floor((F.col("n") - most) / stride) + 1).otherwise(1)
    return _starts(sequences, count, stride, ["seq_id", "n"]).withColumn("stop", F.when(F.col("n") > most, F.col("start") + most).otherwise(F.col("n"))).drop("n")


def paired_chunks(sequences: DataFrame, size: int = 26, train: bool = True, inclusive: bool = False) -> DataFrame:
    """Chunks of two streams of ratio 2:1, half overlapping in training only.

    The fast stream has n frames. Without `inclusive` the last start stays below
    n - size, with it n - size is one.
    """
    stride = size // 2 if train else size
    room = F.col("n") - size
    count = F.floor(room / stride) + 1 if inclusive else F.ceil(room / stride)
    x = _starts(sequences, F.when(room >= 0, count).otherwise(0), stride, ["seq_id"])
    return x.withColumn("stop", F.col("start") + size).withColumn("slow_start", F.floor(F.col("start") / 2)).withColumn("slow_stop", F.floor(F.col("start") / 2) + size // 2)


def cross_rate(clips: DataFrame, fast: int = 16000, slow: int = 25) -> DataFrame:
    """Bounds of clips of one rate in a stream of another."""
    return clips.withColumn("other_start", F.floor(F.col("start") * fast / slow)).withColumn("other_len", F.floor((F.col("stop") - F.col("start")) / slow * fast))


def fixed_chunks(sequences: DataFrame, size: int = 800, least: int = 1) -> DataFrame:
    """Neighbouring chunks of `size`; the last may be shorter, but not than `least`."""
    x = _starts(sequences, F.ceil(F.col("n") / size), size, ["seq_id", "n"]).withColumn("stop", F.least(F.col("start") + size, F.col("n")))
    return x.where(F.col("stop") - F.col("start") >= least).drop("n")


def restitch(chunks: DataFrame) -> DataFrame:
    """Arrays of chunks joined again, in chunk order: (seq_id, values)."""
    return chunks.groupBy("seq_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("clip", "values"))), lambda x: x["values"])).alias("values"))


def every_kth(frames: DataFrame, k: int, drop_last: bool = False) -> DataFrame:
    """Every k-th frame; `drop_last` never takes a sequence's last one."""
    from pyspark.sql import Window

    x = frames.where(F.col("frame") % k == 0) if not drop_last else frames.withColumn("_last", F.max("frame").over(Window.partitionBy("seq_id"))).where((F.col("frame") % k == 0) & (F.col("frame") < F.col("_last"))).drop("_last")
    return x
