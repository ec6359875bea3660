"""Windowed and stateful operators on streams; each also runs on batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType


def activity_windows(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums per tumbling window and event type; late rows are dropped on streams."""
    x = events.withWatermark("ts", late) if events.isStreaming else events
    return x.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: events less than `gap` apart."""
    x = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.session_window("ts", gap)
    return x.groupBy(w, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def online_means(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Running weighted means: on streams in update mode, a row per changed key."""
    return rows.groupBy(key).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"), F.sum(weight).alias("weight"))


#: Timers and value states need this store; it keeps state on disk beside memory.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BufferedStream(StatefulProcessor):
    """A stream's unfinished samples and the number of its next part, as state.

    `step(tail, x, last)` gives the samples that are done (None: no part of them) and those
    that are held, for the next chunk x. A stream that has been idle for `idle_ms` of event time is flushed by a
    timer, and its state cleared; so is one whose chunk is the last.
    """

    def __init__(self, step: Callable[[np.ndarray, np.ndarray, bool], tuple[np.ndarray | None, np.ndarray]], key: str, idle_ms: int | None):
        self.step, self.key, self.idle_ms = step, key, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("held", "tail binary, part int")

    def _held(self) -> tuple[np.ndarray, int]:
        tail, part = self.state.get() if self.state.exists() else (b"", 0)
        return np.frombuffer(bytes(tail), np.float64), part

    def _frame(self, key: tuple, out: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], part, x.tolist()) for part, x in out], columns=[self.key, "part", "samples"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tail, part = self._held()
        out, ended, at = [], False, None
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            done, tail = self.step(tail, np.array(row.samples, np.float64), bool(row.last))
            if done is not None:
                out.append((part, done))
                part += 1
            ended = bool(row.last)
            at = row.ts if self.idle_ms is not None else None
        for timer in list(self.handle.listTimers()) if self.idle_ms is not None else []:
            self.handle.deleteTimer(timer)
        if ended and not len(tail):
            self.state.clear()
        else:
            self.state.update((tail.tobytes(), part))
            if self.idle_ms is not None:
                self.handle.registerTimer(int(at.timestamp() * 1000) + self.idle_ms)
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tail, part = self._held()
        self.state.clear()
        if len(tail):
            yield self._frame(key, [(part, tail)])

    def close(self) -> None:
        pass


def _buffered(chunks: DataFrame, step: Callable, idle: str | None, late: str) -> DataFrame:
    """(stream_id, part, samples) of chunks (stream_id, seq, samples, last[, ts])."""
    kind = chunks.schema["stream_id"].dataType.simpleString()
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    idle_ms = None
    if idle is not None:
        idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
        chunks = chunks.withWatermark("ts", late)
    return chunks.groupBy("stream_id").transformWithStateInPandas(BufferedStream(step, "stream_id", idle_ms), f"stream_id {kind}, part int, samples array<double>", "Append", "None" if idle is None else "EventTime")


def split_at_silence(chunks: DataFrame, rate: int = 16000, silence: float = 0.1, level_db: float = -40.0, idle: str | None = None, late: str = "1 minute") -> DataFrame:
    """Per stream, samples up to the end of the last silence, as they come.

    `chunks` has stream_id, seq, samples (array of double) and last (boolean). A
    silence is `silence` seconds below `level_db`, relative to the buffer's maximum;
    the last one's start is the split, and its end the first sample from there that is
    not below `level_db` of the maximum of the rest. `last` flushes the buffer and
    ends the stream; with `idle` (and a column ts) a timer does so for a stream without
    chunks for that long. State is the unfinished tail, as bytes.
    """
    least = int(rate * silence)

    def loud(x: np.ndarray) -> np.ndarray:
        level = np.maximum(np.abs(x), 1e-5)
        return level >= level.max(initial=0) * 10 ** (level_db / 20)

    def boundary(x: np.ndarray) -> int:
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (~loud(x)).astype(np.int8), [0]))))
        ends = [int(b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= least]
        if not ends:
            return 0
        split = ends[-1] - least
        return split + int(loud(x[split:]).argmax())

    def step(tail: np.ndarray, x: np.ndarray, last: bool) -> tuple[np.ndarray | None, np.ndarray]:
        x = np.concatenate((tail, x))
        cut = len(x) if last else boundary(x)
        return x[:cut] if cut else None, x[cut:]

    return _buffered(chunks, step, idle, late)


def codebook_at(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest finished version of a codebook table, or the given one."""
    if version is None:
        version = spark.read.parquet(f"{path}/finished").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{path}/version={version}")


def start_codebook(codebook: DataFrame, path: str) -> None:
    """Writes version 0 of a codebook table: code, i, count, total, value."""
    codebook.write.mode("overwrite").parquet(f"{path}/version=0")
    codebook.sparkSession.range(1).select(F.lit(0).cast("long").alias("version")).write.mode("overwrite").parquet(f"{path}/finished")


def merge_codebook(batch: DataFrame, batch_id: int, path: str, mu: float = 0.99) -> None:
    """A foreachBatch step: decays the codebook table at `path` by a batch of (code, vec).

    Batch n makes version n + 1 from version n, so a batch that is tried again writes
    the same version again; readers see a version once it is finished.
    """
    from weftline.operators.codes import ema_update

    spark = batch.sparkSession
    new = ema_update(codebook_at(spark, path, batch_id), batch, mu).drop("is_replaced")
    new.write.mode("overwrite").parquet(f"{path}/version={batch_id + 1}")
    spark.range(1).select(F.lit(batch_id + 1).cast("long").alias("version")).write.mode("append").parquet(f"{path}/finished")


def fade_overlaps(chunks: DataFrame, overlap: int, idle: str | None = None, late: str = "1 minute") -> DataFrame:
    """Per stream, chunks whose first `overlap` samples fade in over the last ones before.

    `chunks` has stream_id, seq, samples and last, with at least `overlap` samples a
    chunk. The halves of a Hamming window weigh the new and the held samples; the last
    `overlap` of a chunk are held for the next one, and `last` gives them all and ends
    the stream, as does a timer after `idle` (with a column ts).
    """
    window = np.hamming(2 * overlap)

    def step(held: np.ndarray, x: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
        if len(held):
            x[:overlap] = x[:overlap] * window[:overlap] + held * window[overlap:]
        stop = len(x) if last else len(x) - overlap
        return x[:stop], x[stop:]

    return _buffered(chunks, step, idle, late)


#: Tokens that a decoder keeps in sight.
CONTEXT = 8192


def growing_prompts(blocks: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Blocks (stream_id, block, tokens) with `prompt_start` and `n_prompt`: where their prompt begins, and its length.

    A prompt is the last `context` tokens before its block, at most. Blocks only refer to
    it, so a stream's blocks stay as long as its tokens; prompt_of makes the ones asked for.
    """
    before = Window.partitionBy("stream_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    x = blocks.withColumn("_n", F.coalesce(F.sum(F.size("tokens")).over(before), F.lit(0)))
    return x.withColumns({"prompt_start": F.greatest(F.col("_n") - context, F.lit(0)), "n_prompt": F.least(F.col("_n"), F.lit(context))}).withColumn("at", F.col("_n")).drop("_n")


def prompt_of(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(stream_id, block, prompt) of the wanted blocks (stream_id, block) of growing_prompts.

    Both meet by stream and bucket of tokens, so a wanted block meets only blocks around its prompt.
    """
    asked = blocks.join(wanted.select("stream_id", "block").distinct(), ["stream_id", "block"]).select("stream_id", F.col("block").alias("_b"), F.col("prompt_start").alias("_from"), F.col("at").alias("_to"))
    bucket = lambda c: F.floor(c / CONTEXT)
    covered = lambda low, high: F.explode(F.sequence(bucket(low), bucket(high)))
    spread = asked.where("_to > _from").withColumn("_k", covered(F.col("_from"), F.col("_to") - 1))
    near = blocks.where(F.size("tokens") > 0).select("stream_id", "block", "at", "tokens").withColumn("_k", covered(F.col("at"), F.col("at") + F.size("tokens") - 1))
    x = spread.join(near, ["stream_id", "_k"]).where((F.col("block") < F.col("_b")) & (F.col("at") + F.size("tokens") > F.col("_from")))
    x = x.where(F.col("_k") == F.greatest(bucket(F.col("at")), bucket(F.col("_from"))))  # where both meet first
    part = F.slice("tokens", F.greatest(F.col("_from") - F.col("at"), F.lit(0)).cast("int") + 1, F.size("tokens"))
    rows = F.array_sort(F.collect_list(F.struct("block", part.alias("part"))))
    made = x.groupBy("stream_id", F.col("_b").alias("block")).agg(F.flatten(F.transform(rows, lambda r: r["part"])).alias("prompt"))
    kind = blocks.schema["tokens"].dataType.simpleString()
    return asked.select("stream_id", F.col("_b").alias("block")).join(made, ["stream_id", "block"], "left").withColumn("prompt", F.coalesce("prompt", F.array().cast(kind)))


def over_prompts(blocks: DataFrame, step: Callable[[np.ndarray], tuple[int, ...]], made: list[str]) -> DataFrame:
    """Blocks (stream_id, block, tokens, ...) without tokens, with the long columns `made` of step(prompt).

    A prompt is all tokens of the stream's blocks before, however many. It is a view of one growing
    buffer, as in a decoder's loop, so no row carries its prompt: a stream's tokens are exchanged
    once, and a task holds one stream's, 8 bytes each. Tokens are integers and not null.
    """
    rest = [c for c in blocks.columns if c != "tokens"]

    def loop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, held, n = object(), np.empty(1024, np.int64), 0
        for batch in batches:
            lists = batch.column("tokens")
            if lists.values.null_count:
                raise ValueError("a token is null")
            ends, flat, out = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False), []
            for key, low, high in zip(batch.column("stream_id").to_pylist(), ends, ends[1:], strict=False):
                if key != stream:
                    stream, n = key, 0
                out.append(step(held[:n]))
                if n + high - low > len(held):
                    held = np.concatenate((held[:n], np.empty(n + high - low, np.int64)))
                held[n : n + high - low] = flat[low:high]
                n += high - low
            new = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * len(made)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + new, names=rest + made)

    kinds = StructType([blocks.schema[c] for c in rest] + [StructField(c, LongType()) for c in made])
    return blocks.repartition("stream_id").sortWithinPartitions("stream_id", "block").mapInArrow(loop, kinds)


def token_blocks(tokens: DataFrame, size: int) -> DataFrame:
    """A stream's tokens (stream_id, at, token) in blocks of `size`, as a decoder takes them."""
    rows = F.array_sort(F.collect_list(F.struct("at", "token")))
    return tokens.groupBy("stream_id", F.floor(F.col("at") / size).alias("block")).agg(F.transform(rows, lambda r: r["token"]).alias("tokens"))
