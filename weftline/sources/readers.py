"""Readers: every one returns a lazy DataFrame with an explicit schema."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Reader = Callable[[SparkSession, str], DataFrame]


def jsonl_texts(spark: SparkSession, path: str, prefix: str = "conv") -> DataFrame:
    """(sample_id, conv_id, text) of JSON lines with conv_id and text."""
    x = spark.read.schema("conv_id string, text string").json(path)
    return x.select(F.concat_ws("_", F.lit(prefix), "conv_id").alias("sample_id"), "conv_id", "text")


def split_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, type string").option("header", True).csv(path)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def semantic_scores(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated (name, start_time, end_time, duration, score, keywords)."""
    return spark.read.schema("name string, start_time double, end_time double, duration double, score double, keywords string").option("sep", "\t").csv(path)


def word_vectors(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(word, vec) of lines `word v1 ... vd`; lines of another width are skipped."""
    parts = F.split("value", " ")
    vec = F.transform(F.slice(parts, 2, width + 1), lambda s: s.try_cast("float"))
    x = spark.read.text(path).select(F.get(parts, 0).alias("word"), vec.alias("vec"), F.size(parts).alias("n"))
    return x.where(F.col("n") == width + 1).where(~F.exists("vec", lambda v: v.isNull())).drop("n")


def conversation_structure(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, k, file) of a JSON object from conversations to speaker files."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("conv_id", "files")).where(F.size("files") >= 2)
    return pairs.select("conv_id", F.posexplode("files").alias("k", "file"))


def facial_frames(spark: SparkSession, path: str) -> DataFrame:
    """(file, frame, weights) of JSON files with a list of frames."""
    schema = "struct<frames:array<struct<weights:array<double>,time:double>>>"
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", schema).alias("j"))
    return text.select("file", F.posexplode("j.frames").alias("frame", "f")).select("file", "frame", F.col("f.weights").alias("weights"))


def captions(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, caption, tokens, start, stop) of `caption#tok tok#from#to`."""
    p = F.split("value", "#")
    x = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("line", "value"))
    x = x.select("file", "line", p.alias("p"))
    number = lambda i: F.nanvl(F.coalesce(F.get("p", i).try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return x.select("file", "line", F.get("p", 0).alias("caption"), F.split(F.get("p", 1), " ").alias("tokens"), number(2).alias("start"), number(3).alias("stop"))


def word_intervals(spark: SparkSession, path: str) -> DataFrame:
    """(file, tier, idx, start, stop, mark) of TextGrid files in the long format."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    tiers = text.select("file", F.posexplode(F.split("value", r"item \[\d+\]:")).alias("tier", "body")).where("tier > 0")
    hits = F.regexp_extract_all("body", F.lit(r'(xmin = [0-9.eE+-]+\s+xmax = [0-9.eE+-]+\s+text = "(?:[^"]|"")*")'), 1)
    rows = tiers.select("file", "tier", F.posexplode(hits).alias("idx", "t"))
    pick = lambda pattern: F.regexp_extract("t", pattern, 1)
    mark = F.regexp_replace(pick(r'(?s)text = "(.*)"$'), '""', '"')
    return rows.select("file", "tier", "idx", pick(r"xmin = ([0-9.eE+-]+)").cast("double").alias("start"), pick(r"xmax = ([0-9.eE+-]+)").cast("double").alias("stop"), mark.alias("mark"))


def bvh_motion(spark: SparkSession, path: str) -> DataFrame:
    """(file, frame, t, channel, value) of BVH files.

    Channels are named joint_channel in the order of the hierarchy. A file is
    read as one text; its frames leave in batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
                head, _, motion = text.partition("MOTION")
                names, joint = [], None
                for line in head.splitlines():
                    w = line.split()
                    if w[:1] in (["ROOT"], ["JOINT"]):
                        joint = w[1]
                    elif w[:1] == ["CHANNELS"]:
                        names += [f"{joint}_{c}" for c in w[2 : 2 + int(w[1])]]
                lines = motion.strip().splitlines()
                dt = float(lines[1].split(":")[1])
                for at in range(2, len(lines), 256):
                    values = [[float(v) for v in x.split()] for x in lines[at : at + 256] if x.strip()]
                    frames = [at - 2 + i for i in range(len(values)) for _ in names]
                    yield pa.record_batch({"file": pa.array([file] * len(frames)), "frame": pa.array(frames, pa.int32()), "t": pa.array([f * dt for f in frames]), "channel": pa.array(names * len(values)), "value": pa.array([v for r in values for v in r], pa.float64())})

    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return text.mapInArrow(run, "file string, frame int, t double, channel string, value double")


def recursive_ids(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(id, file) of all files below a path; the id is the path without suffix."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    return x.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), f"{suffix}$".replace(".", "[.]"), "").alias("id"), F.col("path").alias("file"))


def raw_motion_lines(spark: SparkSession, path: str, skip: int = 431, stride: int = 1) -> DataFrame:
    """(file, line, vec): the numbers of every stride-th line of motion files, without the first `skip`."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    kept = text.where((F.col("line") >= skip) & (F.col("line") % stride == 0) & (F.trim("value") != ""))
    return kept.select("file", "line", F.transform(F.split(F.trim("value"), r"\s+"), lambda s: s.try_cast("double")).alias("vec"))


def sentence_texts(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of transcript files with lines `id TEXT`."""
    x = spark.read.text(path).where(F.trim("value") != "")
    return x.select(F.substring_index("value", " ", 1).alias("id"), F.trim(F.expr("substring(value, instr(value, ' ') + 1)")).alias("text"))


READERS: dict[str, Reader] = {"jsonl_texts": jsonl_texts, "split_rules": split_rules, "id_list": id_list, "semantic_scores": semantic_scores, "conversation_structure": conversation_structure, "facial_frames": facial_frames, "captions": captions, "word_intervals": word_intervals, "bvh_motion": bvh_motion}


def read_all(spark: SparkSession, parts: list[tuple[str, str]]) -> DataFrame:
    """The bag union of named readers; columns that one lacks are null."""
    from functools import reduce

    frames = [READERS[name](spark, path).withColumn("dataset", F.lit(name)) for name, path in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
