"""Writers: Parquet caches, keyed records, idempotent appends, text formats."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.corpus import not_done, range_number, ranked
from weftline.sources.bvh import Bone

# What Spark writes as %XX in the name of a folder.
ESCAPED = {chr(i) for i in range(1, 32)} | set("\"#%'*/:=?\\\x7f{[]^")


def write_cache(rows: DataFrame, path: str) -> None:
    """A compressed Parquet table; maps become JSON text."""
    plain = [F.to_json(c).alias(c) if t.startswith("map") else F.col(c) for c, t in rows.dtypes]
    rows.select(*plain).write.mode("overwrite").option("compression", "zstd").parquet(path)


def keyed(rows: DataFrame, order: str) -> DataFrame:
    """Rows with a key of five digits or more in the given order, without one global sort.

    The order is numeric; its ranges are counted first, and keys start in each range
    after those before it.
    """
    x = ranked(rows, range_number(rows, F.col(order)), [order], "_key")
    text = F.col("_key").cast("string")
    return x.withColumn("key", F.lpad(text, F.greatest(F.lit(5), F.length(text)), F.lit("0"))).drop("_key")


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Appends rows whose key the table does not hold yet."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path)
    except Exception as missing:  # noqa: BLE001  the first run has no table
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        done = spark.createDataFrame([], rows.schema)
    not_done(rows, done, key).write.mode("append").parquet(path)


def write_ids(rows: DataFrame, path: str, exclude: list[str]) -> None:
    rows.where(~F.col("id").isin(exclude)).write.mode("overwrite").option("header", True).csv(path)


def write_motion_lines(frames: DataFrame, path: str) -> None:
    """One line of values a frame, in order of (seq_id, frame), a file per range."""
    line = F.array_join(F.transform("vec", lambda x: F.format_string("%.6f", x)), " ")
    frames.repartitionByRange("seq_id", "frame").sortWithinPartitions("seq_id", "frame").select(line.alias("value")).write.mode("overwrite").text(path)


def write_responses(rows: DataFrame, path: str) -> None:
    """A text dump of (id, response): a header line with the id, then the response, an empty line after."""
    line = F.concat(F.lit("== "), F.col("id").cast("string"), F.lit(" ==\n"), F.coalesce("response", F.lit("")), F.lit("\n"))
    rows.repartitionByRange("id").sortWithinPartitions("id").select(line.alias("value")).write.mode("overwrite").text(path)


def bvh_head(bones: list[Bone]) -> str:
    """The hierarchy of a motion file; joints come parents first, end sites end in `_Nub`."""
    below: dict[str | None, list[Bone]] = {}
    for b in bones:
        below.setdefault(b.parent, []).append(b)
    lines, open_ = ["HIERARCHY"], [(b, 0) for b in reversed(below.get(None, []))]
    while open_:  # depth first, without recursion
        item, depth = open_.pop()
        pad = "  " * depth
        if item is None:
            lines.append(f"{pad}}}")
            continue
        end = item.name == f"{item.parent}_Nub"
        lines += [f"{pad}{'ROOT ' + item.name if item.parent is None else 'End Site' if end else 'JOINT ' + item.name}", f"{pad}{{", f"{pad}  OFFSET {' '.join(repr(float(x)) for x in item.offset)}"]
        if not end:
            lines.append(f"{pad}  CHANNELS {len(item.channels)} {' '.join(item.channels)}".rstrip())
        open_.append((None, depth))
        open_ += [(b, depth + 1) for b in reversed(below.get(item.name, []))]
    return "\n".join(lines)


def write_bvh(frames: DataFrame, bones: list[Bone], path: str, dt: float) -> None:
    """A motion file a sequence: its hierarchy, then a line a frame with all channels in its order.

    `frames` has seq_id, frame and values; a file's folder is named by the sequence. Frames
    with another number of values than the hierarchy has channels are left out.
    """
    width = sum(len(b.channels) for b in bones)
    line = F.array_join(F.transform("values", lambda x: F.format_string("%.6f", x.cast("double"))), " ")
    x = frames.where(F.size("values") == width).select("seq_id", "frame", line.alias("line"))
    rows = F.array_sort(F.collect_list(F.struct("frame", "line")))
    text = F.concat(F.lit(bvh_head(bones) + "\nMOTION\nFrames: "), F.count("*").cast("string"), F.lit(f"\nFrame Time: {dt}\n"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n"))
    write_texts(x.groupBy("seq_id").agg(text.alias("value")), "seq_id", path)


def _local(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system has it, if that is where Spark writes it."""
    scheme, _, at = path.rpartition(":/")
    if not scheme and not spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:"):
        return None
    return os.path.abspath(re.sub("^/+", "/", f"/{at}") if scheme else path) if scheme in ("", "file") else None


def write_texts(rows: DataFrame, key: str, path: str) -> None:
    """A file a row with its `value`, in a folder named by its key; keys are unique.

    What stands at the path is replaced once all is written. Where Spark writes through
    Hadoop's local files, each folder, file and checksum starts processes that set its
    rights, which takes longer than all else; so tasks write there on their own.
    """
    at = _local(rows.sparkSession, path)
    if at is None:
        rows.select(key, "value").repartition(key).write.mode("overwrite").partitionBy(key).text(path)
        return
    fs, new = pafs.LocalFileSystem(), f"{at}-{uuid.uuid4().hex}"

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = pafs.LocalFileSystem()
        for batch in batches:
            for name, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist(), strict=True):
                folder = f"{new}/{key}={''.join(f'%{ord(c):02X}' if c in ESCAPED else c for c in name) if name else '__HIVE_DEFAULT_PARTITION__'}"
                file = f"part-{'00001' if name == '' else '00000'}.txt"  # an empty name has the folder of none
                fs.create_dir(folder)
                with fs.open_output_stream(part := f"{folder}/.{file}-{uuid.uuid4().hex}") as out:
                    out.write(f"{value}\n".encode())
                fs.move(part, f"{folder}/{file}")  # whole, also when a task is tried again
            yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64())})

    fs.create_dir(new)
    rows.where(F.col("value").isNotNull()).select(F.col(key).cast("string").alias("name"), "value").mapInArrow(save, "n long").agg(F.sum("n")).collect()
    with fs.open_output_stream(f"{new}/_SUCCESS"):
        pass
    if fs.get_file_info(at).type != pafs.FileType.NotFound:
        fs.delete_dir(at)
    fs.move(new, at)
