"""Connected components by alternating stars, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Drops the shuffle files of a plan once it has run.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints; a temporary one only where all runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """The rows from a Parquet table in the shared folder; the lineage ends there."""
    path = f"{_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def quoted(names: list[str]) -> list[Column]:
    """Columns by their whole names, dots included."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def packed(names: list[str]) -> Column:
    """The columns as one, `row`, whose fields have plain names."""
    return F.struct(*[c.alias(f"c{i}") for i, c in enumerate(quoted(names))]).alias("row")


def unpacked(names: list[str], **instead: Column) -> list[Column]:
    """The columns of `row` by their names, or those given instead."""
    return [instead.get(n, F.col(f"row.c{i}")).alias(n) for i, n in enumerate(names)]


def clash(name: str, others: list[str]) -> bool:
    """Whether a column has one of the names, in upper or lower case."""
    return name.lower() in {o.lower() for o in others}


def appended(df: DataFrame, *columns: str) -> DataFrame:
    """As `written`, in folders by the given columns, with the schema of `df`."""
    path = f"{_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*columns).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a DataFrame that `written` gave, once nothing reads them."""
    spark = df.sparkSession
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for path in paths:
        if path.rsplit("/", 1)[-1].startswith("table-"):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder that the cluster names.

    Nothing reads the shuffle files of the plan again, so they go at once.
    """
    spark = df.sparkSession
    _folder(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # a plan made after the setting
    finally:
        spark.conf.set(_CLEANUP, before)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The links (child, root) of a spanning forest of the given links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        path = []
        while (up := parent.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for y in path:
            parent[y] = x
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
    return [(x, r) for x in list(parent) if (r := root(x)) != x]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of a task's links, in parts of a bounded size."""
    a, b = [], []

    def pack() -> list[tuple[int, int]]:
        return forest(np.concatenate(a), np.concatenate(b)) if a else []

    def out(kept: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.record_batch({"u": pa.array([x for x, _ in kept], pa.int64()), "v": pa.array([y for _, y in kept], pa.int64())})

    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
        if sum(map(len, a)) > 1_000_000:
            kept = pack()
            if len(kept) > 500_000:
                yield out(kept)
                kept = []
            a, b = [np.array([x for x, _ in kept], np.int64)], [np.array([y for _, y in kept], np.int64)]
    yield out(pack())


def _only_stars(links: DataFrame) -> bool:
    """Whether each node has one link up or some from below, and not both."""
    ends = links.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (u, v) of longs.

    Each task first keeps a spanning forest of its links. Then large and small
    stars alternate until only stars are left, in a logarithmic number of rounds.
    No star is gathered in a task: its smallest node is an aggregate. Links with
    a null end and loops are left out; nodes without links do not appear.
    """
    links = links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    tasks = max(links.sparkSession.sparkContext.defaultParallelism, 1)
    links = cut(links.coalesce(tasks).mapInArrow(_contract, "u long, v long").where("u > v").distinct())
    while not _only_stars(links):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        links = cut(small)
    roots = links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
