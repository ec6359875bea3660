"""Windowed queries over events; the streaming operators as batches, and a stream
that runs to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.plans._tables import r6, table
from weftline.plans.files import _folder
from weftline.sources import arrays
from weftline.streaming import tokens, windows


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def activity_windows(spark, sf_dir):
    x = windows.activity_windows(_events(spark, sf_dir))
    return x.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def session_activity(spark, sf_dir):
    x = windows.sessions(_events(spark, sf_dir))
    return x.select("user_id", F.unix_timestamp("start").alias("start_s"), "n")


def online_metrics(spark, sf_dir):
    x = windows.online_means(table(spark, sf_dir, "events").withColumn("w", F.col("event_id") % 5 + 1), "event_type", "value", "w")
    return x.select("event_type", r6(F.col("mean")).alias("mean"), "weight")


def _chunks(spark, sf_dir):
    """Users' events as a stream of chunks of four samples; each user's last event ends the stream."""
    events = table(spark, sf_dir, "events")
    ends = events.groupBy("user_id").agg(F.max("event_id").alias("end"))
    e = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*").join(ends, "user_id")
    return e.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.array_repeat(F.when(F.col("value") > 8, F.col("value")).otherwise(0.0), 4).alias("samples"), (F.col("event_id") == F.col("end")).alias("last"))


def _ran(spark, rows):
    """The rows of a stream that runs to its end, from a file sink that has each of them once."""
    path = _folder(spark)
    rows.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


def silence_split(spark, sf_dir):
    x = _ran(spark, windows.split_at_silence(_chunks(spark, sf_dir), rate=100, silence=0.08))
    total = F.aggregate("samples", F.lit(0.0), lambda s, v: s + v)
    return x.select("stream_id", "part", F.size("samples").cast("long").alias("n"), F.round(total, 4).alias("total"))


def fade_overlaps(spark, sf_dir):
    x = _ran(spark, windows.fade_overlaps(_chunks(spark, sf_dir), 2))
    return x.select("stream_id", "part", F.size("samples").cast("long").alias("n"), *[r6(F.get("samples", i)).alias(f"x{i}") for i in range(4)])


def token_stream(spark, sf_dir):
    """Tokens from files of which half come after the stream was stopped; it goes on from its checkpoint."""
    path = _folder(spark)
    e = table(spark, sf_dir, "events")
    number = F.floor(F.col("event_id") / 2500)
    rows = e.select(F.lpad(number.cast("string"), 12, "0").alias("file"), F.lit(None).alias("name"), F.col("event_id").alias("at"), F.array((F.col("event_id") * 7 % 512).cast("double")).alias("vec"), (number % 2).alias("odd"), number.alias("number"))
    half = e.agg(F.max(number)).first()[0] // 2
    for part in (rows.where(F.col("number") <= half), rows.where(F.col("number") > half)):
        arrays.write_arrays(part, f"{path}/tokens").count()
        tokens.run_to_end(tokens.token_stream(spark, f"{path}/tokens", 1000), f"{path}/sink", f"{path}/state")
    return spark.read.parquet(f"{path}/sink").select("at", "token")


QUERIES = {f.__name__: f for f in (activity_windows, session_activity, online_metrics, silence_split, fade_overlaps, token_stream)}
_EVENTS = """d AS (SELECT user_id, event_id, CASE WHEN value > 8 THEN value ELSE 0 END AS x FROM events),
e AS (SELECT *, x = 0 AS quiet, lag(x = 0) OVER o AS before, row_number() OVER o AS i, COUNT(*) OVER (PARTITION BY user_id) AS n FROM d WINDOW o AS (PARTITION BY user_id ORDER BY event_id))"""
ORACLE = {
    "activity_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, COUNT(*) AS n, round(SUM(value), 4) AS total FROM events GROUP BY ALL",
    "session_activity": """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
b AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a) SELECT user_id, CAST(floor(epoch(MIN(ts))) AS BIGINT) AS start_s, COUNT(*) AS n FROM b GROUP BY user_id, s""",
    "online_metrics": "SELECT event_type, round(SUM(value * (event_id % 5 + 1)) / SUM(event_id % 5 + 1), 6) + 0.0 AS mean, CAST(SUM(event_id % 5 + 1) AS BIGINT) AS weight FROM events GROUP BY 1",
    "silence_split": f"""WITH {_EVENTS}, r AS (SELECT *, SUM(CASE WHEN quiet = before THEN 0 ELSE 1 END) OVER o AS run FROM e WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
z AS (SELECT *, COUNT(*) OVER (PARTITION BY user_id, run) AS size, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS place FROM r),
c AS (SELECT *, CASE WHEN quiet AND place = 1 AND size >= 2 AND i > 1 AND i + 1 < n THEN 1 WHEN NOT quiet AND place = 1 AND i > 1 AND i < n AND lag(size) OVER o >= 2 THEN 1 ELSE 0 END AS cut FROM z WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
p AS (SELECT *, SUM(cut) OVER (PARTITION BY user_id ORDER BY event_id) AS part FROM c)
SELECT user_id AS stream_id, CAST(part AS INTEGER) AS part, 4 * COUNT(*) AS n, round(4 * SUM(x), 4) AS total FROM p GROUP BY user_id, part""",
    "fade_overlaps": f"""WITH {_EVENTS}, w AS (SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM e)
SELECT user_id AS stream_id, CAST(i - 1 AS INTEGER) AS part, CASE WHEN i = n THEN 4 ELSE 2 END AS n, round(CASE WHEN i = 1 THEN x ELSE 0.08::DOUBLE * x + 0.77::DOUBLE * b END, 6) + 0.0 AS x0, round(CASE WHEN i = 1 THEN x ELSE 0.77::DOUBLE * x + 0.08::DOUBLE * b END, 6) + 0.0 AS x1,
CASE WHEN i = n THEN round(x, 6) + 0.0 END AS x2, CASE WHEN i = n THEN round(x, 6) + 0.0 END AS x3 FROM w""",
    "token_stream": "SELECT row_number() OVER (ORDER BY event_id) - 1 AS at, event_id * 7 % 512 AS token FROM events",
}
