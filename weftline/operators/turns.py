"""Conversation shaping: rounds, budgets, speaking turns, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import tokens as T

SYSTEM_TEXT = "<|system|>\nYou are a helpful assistant."


def rounds(turns: DataFrame, require: Column | None = None) -> DataFrame:
    """(conv_id, round, text): user turns with all that follow up to the next one.

    Rows before the first user turn and system rows are dropped; only rounds
    with an assistant turn are complete and kept, numbered from 0. `require` can
    test the text further.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    tagged = turns.where("role <> 'system'").withColumn("r", F.sum((F.col("role") == "user").cast("int")).over(order)).where("r > 0")
    part = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x["part"]), "")
    done = tagged.groupBy("conv_id", "r").agg(texts.alias("text"), F.max((F.col("role") == "assistant").cast("int")).alias("answered")).where("answered = 1")
    done = done.where(require) if require is not None else done
    return done.withColumn("round", F.row_number().over(Window.partitionBy("conv_id").orderBy("r")) - 1).select("conv_id", "round", "text")


def round_windows(turns: DataFrame, num_rounds: int = 11, max_tokens: int | None = None, system: str = SYSTEM_TEXT, require: Column | None = None) -> DataFrame:
    """All windows of `num_rounds` neighbouring complete rounds, one step apart.

    Returns conv_id, window_idx, n_tokens and text (the system text first);
    windows of more than `max_tokens` tokens are dropped.
    """
    ahead = Window.partitionBy("conv_id").orderBy("round").rowsBetween(0, num_rounds - 1)
    w = rounds(turns, require).withColumn("parts", F.collect_list("text").over(ahead)).where(F.size("parts") == num_rounds)
    w = w.select("conv_id", F.col("round").cast("long").alias("window_idx"), F.concat(F.lit(system), F.array_join("parts", "")).alias("text")).withColumn("n_tokens", T.count_tokens(F.col("text")))
    return w.where(F.col("n_tokens") <= max_tokens) if max_tokens is not None else w


def budget_prefix(turns: DataFrame, budget: int = 1024, start: int = 49) -> DataFrame:
    """The turns of each conversation up to the first that goes over the budget."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    used = turns.withColumn("n_tokens", T.count_tokens(F.col("text"))).withColumn("used", F.sum("n_tokens").over(order) + start)
    return used.where(F.col("used") <= budget)


def speaking_turns(frames: DataFrame, threshold: float = 0.2, gap: int = 10) -> DataFrame:
    """(seq_id, start, stop, turn): turns that end at `gap` silent frames.

    `frames` has seq_id, frame and value; activity is |value| over the largest
    |value| of the sequence, silence is below `threshold`. Shorter silences are
    bridged, a short one at the end stays inside; silent sequences give nothing.
    """
    whole, order = Window.partitionBy("seq_id"), Window.partitionBy("seq_id").orderBy("frame")
    x = frames.withColumn("top", F.max(F.abs("value")).over(whole)).withColumn("last", F.max("frame").over(whole)).where("top > 0 and abs(value) / top >= %r" % threshold)
    x = x.withColumn("new", F.coalesce(F.col("frame") - F.lag("frame").over(order) > gap, F.lit(True)).cast("int")).withColumn("t", F.sum("new").over(order))
    ends = x.groupBy("seq_id", "t").agg(F.min("frame").alias("start"), F.max("frame").alias("end"), F.max("last").alias("last"))
    # silence after the last active frame belongs to the turn if the sequence ends within it
    stop = F.when(F.col("last") - F.col("end") < gap, F.col("last") + 1).otherwise(F.col("end") + 1)
    return ends.select("seq_id", "start", stop.alias("stop"), (F.row_number().over(Window.partitionBy("seq_id").orderBy("start")) - 1).alias("turn"))


def interleave_turns(turns: DataFrame, size: int = 26, stride: int = 13) -> DataFrame:
    """Chunks of the turns of all speakers of a conversation, in order of start.

    `turns` has conv_id, speaker, start and stop. Turns shorter than `size` are
    skipped; the slow stream has half the rate. chunk_id counts in emit order.
    """
    chunks = F.floor((F.col("stop") - F.col("start") - size) / stride).cast("int")
    cut = turns.where(F.col("stop") - F.col("start") >= size).withColumn("i", F.explode(F.sequence(F.lit(0), chunks)))
    at = F.col("start") + F.col("i") * stride
    order = Window.partitionBy("conv_id").orderBy("start", "speaker", "i")
    return cut.select("conv_id", "speaker", "start", at.alias("fast_start"), F.floor(at / 2).alias("slow_start"), "i", (F.row_number().over(order) - 1).alias("chunk_id")).drop("i")


def pause_sentences(words: DataFrame) -> DataFrame:
    """(seq_id, sentence, text, start, stop): words between blank marks.

    `words` has seq_id, idx, mark, start and stop.
    """
    order = Window.partitionBy("seq_id").orderBy("idx")
    blank = F.col("mark").isNull() | (F.trim("mark") == "")
    x = words.withColumn("s", F.sum(blank.cast("int")).over(order)).where(~blank)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "mark"))), lambda w: w["mark"]), " ")
    x = x.groupBy("seq_id", "s").agg(text.alias("text"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    return x.select("seq_id", (F.row_number().over(Window.partitionBy("seq_id").orderBy("s")) - 1).alias("sentence"), "text", "start", "stop")


def merge_paragraphs(sentences: DataFrame, longest: float) -> DataFrame:
    """(seq_id, paragraph, text, start, stop): sentences merged while they fit.

    A paragraph takes the next sentence if it then lasts no longer than
    `longest`. This is a fold, so it runs over the ordered array of a sequence.
    """
    item = F.struct("sentence", "text", F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop"))
    rows = sentences.groupBy("seq_id").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    kind = "array<struct<text:string,start:double,stop:double>>"
    one = lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["stop"].alias("stop"))

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(F.concat(last["text"], F.lit(" "), x["text"]).alias("text"), last["start"].alias("start"), x["stop"].alias("stop"))
        fits = (F.size(done) > 0) & (x["stop"] - last["start"] <= longest)
        return F.when(fits, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(one(x)))).cast(kind)

    folded = rows.select("seq_id", F.aggregate("xs", F.array().cast(kind), step).alias("ps"))
    return folded.select("seq_id", F.posexplode("ps").alias("paragraph", "p")).select("seq_id", "paragraph", "p.*")


def proper_pairs(sides: DataFrame) -> DataFrame:
    """Conversations with exactly two speakers, as one row (speaker 0, speaker 1).

    `sides` has conv_id, speaker and any payload columns.
    """
    order, whole = Window.partitionBy("conv_id").orderBy("speaker"), Window.partitionBy("conv_id")
    x = sides.withColumn("n", F.count("*").over(whole)).where("n = 2").withColumn("k", F.row_number().over(order))
    payload = [c for c in sides.columns if c != "conv_id"]
    pick = [F.max(F.when(F.col("k") == k + 1, F.col(c))).alias(f"{c}_{k}") for k in (0, 1) for c in payload]
    return x.groupBy("conv_id").agg(*pick)
