"""Driver tables in the shape of the operators' inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as frames: seq_id, frame, value, event_id, event_type, ts."""
    e = table(spark, sf_dir, "events")
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("seq_id"), frame.alias("frame"), "value", "event_id", "event_type", "ts")


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, n): frames of each user."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("seq_id")).agg(F.count("*").alias("n"))


def vectors(spark: SparkSession, sf_dir: str, width: int = 64) -> DataFrame:
    """(vec_id, vec, label) with doubles."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, width).alias("vec"), "label")


def r6(c: Column) -> Column:
    """Rounded to six places; a negative zero becomes zero."""
    return F.round(c, 6) + F.lit(0.0)


# SQL of the same shapes, as common table expressions.
FRAMES = "frames AS (SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value, event_id, event_type, ts FROM events)"
VECTORS = "vectors AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec, label FROM embeddings)"
DIST = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
