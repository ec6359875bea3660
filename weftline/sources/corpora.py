"""Composed corpus loaders: what a training set of one kind needs, from its tables.

Each takes the tables that readers give and returns one row a sample; nothing is
collected, and arrays hold one clip, turn or utterance, never a whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import align, clips, features
from weftline.operators.corpus import complete_only, split_rule


#: Frames of a bucket, in which windows and frames meet.
BUCKET = 64


def _arrays(frames: DataFrame, windows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Windows with one array a column: the frames from start to before stop, in order.

    Both sides meet by sequence and bucket of frames, so a frame is paired with the
    windows around it only, however long its sequence is.
    """
    spread = windows.where("stop > start").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor((F.col("stop") - 1) / BUCKET))))
    near = frames.select("seq_id", "frame", *columns).withColumn("_bucket", F.floor(F.col("frame") / BUCKET))
    hit = spread.join(near, ["seq_id", "_bucket"]).where((F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("stop")))
    rows = F.array_sort(F.collect_list(F.struct("frame", *columns)))
    got = hit.groupBy(*keys, "start", "stop").agg(rows.alias("_rows"))
    return got.select(*keys, "start", "stop", *[F.col(f"_rows.`{c}`").alias(c) for c in columns])


def motion_clips(frames: DataFrame, rules: DataFrame, split: str, speakers: list[int], columns: list[str], fps: int = 25, length: int = 64, stride: int = 20, additional: bool = False, keep_every: int = 1, mask: list[int] | None = None, stats: DataFrame | None = None) -> DataFrame:
    """(seq_id, clip, start, stop, columns...): the clips of a split's motion sequences.

    `frames` has seq_id, frame and the columns; `rules` id and type, with ids that
    start with the speaker's number. Training clips overlap, those of other splits are
    whole sequences. `keep_every` lowers the frame rate first, `mask` selects channels
    of the first column, `stats` (i, mean, std) standardises it.
    """
    ids = split_rule(frames.select(F.col("seq_id").alias("id")).distinct(), rules, split, speakers, additional).select(F.col("id").alias("seq_id"))
    x = frames.join(ids, "seq_id", "left_semi")
    if keep_every > 1:
        x = clips.every_kth(x, keep_every).withColumn("frame", F.floor(F.col("frame") / keep_every))
    if mask is not None:
        x = x.withColumn(columns[0], features.mask_select(F.col(columns[0]), mask))
    if stats is not None:
        x = features.standardize(x.withColumnRenamed(columns[0], "vec"), stats).withColumnRenamed("vec", columns[0])
    sizes = x.groupBy("seq_id").agg(F.count("*").alias("n"))
    return _arrays(x, clips.clip_slices(sizes, fps, length, stride, train=split in ("train", "additional")), columns, ["seq_id", "clip"])


def listed_clips(clips_: DataFrame, ids: DataFrame, prefix: str = "", required: list[str] | None = None) -> DataFrame:
    """Clips (seq_id, ...) whose sequence an id list names, without a prefix of the list's ids.

    Clips without one of the `required` arrays are dropped, as are ids without clips.
    """
    wanted = ids.select(F.regexp_replace("id", "^\\Q" + prefix + "\\E", "").alias("seq_id") if prefix else F.col("id").alias("seq_id")).distinct()
    x = clips_.join(wanted, clips_.seq_id.cast("string") == wanted.seq_id, "left_semi")
    for c in required or []:
        x = x.where(F.size(c) > 0)
    return x


def segment_sequences(frames: DataFrame, columns: list[str], most: int = 500, stride: int = 250, least: int = 10) -> DataFrame:
    """(seq_id, clip, start, stop, columns...): long sequences in segments, shorter ones whole, those of up to `least` frames not at all."""
    sizes = frames.groupBy("seq_id").agg(F.count("*").alias("n")).where(F.col("n") > least)
    return _arrays(frames, clips.segments_or_whole(sizes, most, stride), columns, ["seq_id", "clip"])


def speaker_pairs(structure: DataFrame, frames: DataFrame, columns: list[str]) -> DataFrame:
    """(conv_id, file_0, n_0, columns_0..., file_1, ...): both speakers of a conversation.

    `structure` has conv_id, k and file, `frames` seq_id (the file), frame and the
    columns. Conversations without exactly two speakers that have frames are dropped;
    both are cut to the shorter one's frames.
    """
    rows = F.array_sort(F.collect_list(F.struct("frame", *columns)))
    tracks = frames.groupBy(F.col("seq_id").alias("file")).agg(rows.alias("rows"))
    sides = structure.join(tracks, "file")
    two = sides.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "file", "rows"))).alias("s"), F.count("*").alias("n")).where("n = 2")
    room = F.least(F.size(F.get("s", 0)["rows"]), F.size(F.get("s", 1)["rows"]))
    cut = lambda i, c: F.transform(F.slice(F.get("s", i)["rows"], 1, F.col("room")), lambda r: r[c])
    two = two.withColumn("room", room)
    return two.select("conv_id", F.col("room").alias("n_frames"), *[x for i in (0, 1) for x in (F.get("s", i)["file"].alias(f"file_{i}"), *[cut(i, c).alias(f"{c}_{i}") for c in columns])])


UTTERANCE_KEY = ["trainset", "speaker_id", "chapter_id", "utterance_id", "part_id"]


def utterance_samples(tokens: DataFrame, texts: DataFrame, tasks: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """Utterances with tokens and a text, once a task: the key, tokens, text and the task's columns.

    Both sides have the five-part key; utterances without a text, or with fewer than
    `least` or more than `most` tokens, are dropped.
    """
    n = F.size("tokens")
    kept = tokens.where((n >= least) & ((n <= most) if most is not None else F.lit(True)))
    return kept.join(texts, UTTERANCE_KEY).crossJoin(tasks)  # every sample with every task, by definition


def transcribed_tokens(tokens: DataFrame, words: DataFrame, rate: float, length: int, stride: int) -> DataFrame:
    """(seq_id, clip, start, stop, tokens, words): token chunks with the words spoken wholly inside.

    `tokens` has seq_id and tokens (an array at `rate` tokens a second), `words` seq_id,
    idx, mark, start and stop in seconds.
    """
    n = F.size("tokens")
    count = F.when(n >= length, F.floor((n - length) / stride) + 1).otherwise(0).cast("int")
    parts = tokens.where(n >= length).withColumn("clip", F.explode(F.sequence(F.lit(0), count - 1)))
    parts = parts.select("seq_id", "clip", (F.col("clip") * stride).alias("at"), F.slice("tokens", F.col("clip") * stride + 1, F.lit(length)).alias("tokens"))
    parts = parts.select("seq_id", "clip", (F.col("at") / rate).alias("start"), ((F.col("at") + length) / rate).alias("stop"), "tokens")
    said = align.contained_words(parts.select("seq_id", "clip", "start", "stop"), words, length / rate)
    return parts.join(said.select("seq_id", "clip", "words"), ["seq_id", "clip"])


def captioned_tokens(tokens: DataFrame, captions: DataFrame, rate: float, least: int, most: int, step: int = 1) -> DataFrame:
    """(seq_id, line, caption, tokens): captions with their part of the sequence.

    A caption from second 0 to 0 stands for the whole sequence; others for tokens
    int(start * rate / step) to int(stop * rate / step). Parts outside the length
    limits are dropped.
    """
    x = tokens.select("seq_id", F.col("tokens").alias("_all")).join(captions, "seq_id")
    low = F.floor(F.col("start") * rate / step).cast("int")
    high = F.floor(F.col("stop") * rate / step).cast("int")
    whole = (F.col("start") == 0) & (F.col("stop") == 0)
    part = F.when(whole, F.col("_all")).otherwise(F.slice("_all", low + 1, F.greatest(high - low, F.lit(0))))
    return x.select("seq_id", "line", "caption", part.alias("tokens")).where(F.size("tokens").between(least, most))


def paired_tokens(sides: DataFrame, size: int = 26, train: bool = True) -> DataFrame:
    """(conv_id, speaker, clip, audio, face): chunks of conversations with two full sides.

    `sides` has conv_id, speaker and arrays audio and face, audio at twice the rate.
    Conversations without exactly two speakers with both arrays are dropped; half
    overlap in training only.
    """
    whole = sides.where((F.size("audio") > 0) & (F.size("face") > 0))
    two = whole.groupBy("conv_id").agg(F.count("*").alias("n")).where("n = 2")
    x = complete_only(whole, "conv_id", two).withColumn("seq_id", F.struct("conv_id", "speaker"))
    parts = clips.paired_chunks(x.select("seq_id", F.least(F.size("audio"), 2 * F.size("face")).alias("n")), size, train, inclusive=True)
    cut = lambda c, low, high: F.slice(c, F.col(low).cast("int") + 1, (F.col(high) - F.col(low)).cast("int"))
    return x.select("seq_id", "audio", "face").join(parts, "seq_id").select("seq_id.conv_id", "seq_id.speaker", "clip", cut("audio", "start", "stop").alias("audio"), cut("face", "slow_start", "slow_stop").alias("face"))


def with_tags(samples: DataFrame, **tags: str | int | float | Column) -> DataFrame:
    """Samples with the same tag columns in every row."""
    return samples.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in tags.items()})
