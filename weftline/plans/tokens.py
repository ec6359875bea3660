"""Token-array queries: event ids of a user as token streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import tokens as T
from weftline.operators import features
from weftline.plans._tables import frames, table

OFFSET = 1024


def _streams(spark, sf_dir):
    """(user_id, a, b): two token arrays of different lengths per user."""
    f = frames(spark, sf_dir)
    tok = F.when(F.col("frame") % 3 < 2, "a").otherwise("b")
    x = f.select("seq_id", "frame", (F.col("event_id") % 512).cast("int").alias("t"), tok.alias("k"))
    pick = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.struct("frame", "t")))), lambda s: s["t"])
    return x.groupBy(F.col("seq_id").alias("user_id")).agg(pick("a").alias("a"), pick("b").alias("b"))


STREAMS = """f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, CAST(event_id % 512 AS INTEGER) AS t FROM events),
s AS (SELECT user_id, COALESCE(list(t ORDER BY frame) FILTER (WHERE frame % 3 < 2), []) AS a, COALESCE(list(t ORDER BY frame) FILTER (WHERE frame % 3 = 2), []) AS b FROM f GROUP BY user_id)"""


def _joined(c, name):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(name)


def combine_interleave(spark, sf_dir):
    x = _streams(spark, sf_dir)
    both = T.interleave(F.col("a"), F.col("b"), OFFSET)
    a, b = T.separate(both, OFFSET)
    return x.select("user_id", _joined(both, "tokens"), _joined(T.fit(both, 40), "fitted"), (a == F.col("a")).alias("same_a"), (b == F.col("b")).alias("same_b"))


def combine_concat(spark, sf_dir):
    x = _streams(spark, sf_dir)
    return x.select("user_id", _joined(T.fit(T.concat(F.col("a"), F.col("b"), OFFSET), 50), "tokens"), _joined(T.model_record(F.col("a"), F.col("b"), OFFSET, 20, 5000, 5001), "record"))


def resample_tokens(spark, sf_dir):
    x, a = _streams(spark, sf_dir), F.col("a")
    return x.select("user_id", _joined(T.upsample(a, 2), "up"), _joined(T.downsample(a, 3), "down"), _joined(T.mean_pool(a, 4), "pooled"), _joined(T.resize_nearest(a, F.size("b")), "nearest"))


def offset_masked(spark, sf_dir):
    x, a = _streams(spark, sf_dir), F.col("a")
    mask = F.transform(a, lambda t: t % 2 == 0)
    return x.select("user_id", _joined(T.offset_masked(a, mask, 10_000), "tokens"), F.array_join(F.transform(T.length_mask(F.size("b"), F.size("a")), lambda m: m.cast("int").cast("string")), "").alias("mask"))


def proportional_cut(spark, sf_dir):
    x = _streams(spark, sf_dir)
    a, b = T.proportional(F.col("a"), F.col("b"), 30)
    return x.select("user_id", F.size(a).cast("long").alias("n_a"), F.size(b).cast("long").alias("n_b"))


def render_parse(spark, sf_dir):
    x = _streams(spark, sf_dir)
    text = F.concat(T.render_tokens(F.col("a"), "audio"), T.render_tokens(F.col("b"), "face"))
    back = T.parse_tokens(text, "audio")
    return x.select("user_id", F.md5(text).alias("text_md5"), (back == F.col("a")).alias("same"), _joined(T.parse_tokens(text, "face"), "face"), F.md5(T.render_interleaved([("face", F.col("b")), ("audio", F.col("a"))])).alias("steps_md5"), T.parse_single(F.concat(F.lit("<|audio_"), F.size("a").cast("string"), F.lit("|>"))).alias("single"), T.parse_single(F.lit("invalid")).alias("invalid"))


def onset_frames(spark, sf_dir):
    x = _streams(spark, sf_dir)
    at = F.transform(F.col("b"), lambda t: t % 32)
    return x.select("user_id", F.array_join(F.transform(T.onsets(at, 32), lambda v: v.cast("string")), "").alias("onsets"), _joined(T.without_sentinels(F.transform("b", lambda t: t - 100), 9), "kept"))


def pad_collate(spark, sf_dir):
    x = _streams(spark, sf_dir).withColumn("batch", F.col("user_id") % 10).withColumn("a", F.col("a").cast("array<double>"))
    padded = features.pad_batches(x.select("user_id", "batch", "a"), "batch", "a")
    back = features.unpad(padded, "a").select("user_id", F.size("a").alias("n_back"))
    return padded.join(back, "user_id").select("user_id", F.size("a").cast("long").alias("padded"), F.col("length").cast("long").alias("length"), F.col("n_back").cast("long").alias("n_back"), F.aggregate("a", F.lit(0.0), lambda s, v: s + v).cast("long").alias("total"))


def collate_records(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 20).alias("batch"), "doc_id", "lang", "n_chars")
    x = features.collate(d, "batch", "doc_id", ["lang", "n_chars"])
    return x.select("batch", F.size("records").cast("long").alias("n"), F.array_join(F.transform("records", lambda r: F.concat(r["doc_id"].cast("string"), F.lit(":"), r["lang"], F.lit(":"), r["n_chars"].cast("string"))), "|").alias("records"))


QUERIES = {f.__name__: f for f in (combine_interleave, combine_concat, resample_tokens, offset_masked, proportional_cut, render_parse, onset_frames, pad_collate, collate_records)}
_IL = "list_filter(flatten(list_transform(generate_series(1, greatest(len(a), len(b))), lambda i: [a[i], b[i] + 1024])), lambda v: v IS NOT NULL)"
_FIT = "list_transform(generate_series(1, {n}), lambda i: COALESCE(({x})[i], 0))"
_STR = "COALESCE(array_to_string({x}, ','), '')"
ORACLE = {
    "combine_interleave": f"WITH {STREAMS}, t AS (SELECT *, {_IL} AS m FROM s) SELECT user_id, {_STR.format(x='m')} AS tokens, {_STR.format(x=_FIT.format(n=40, x='m'))} AS fitted, TRUE AS same_a, TRUE AS same_b FROM t",
    "combine_concat": f"WITH {STREAMS}, t AS (SELECT *, {_IL} AS m, list_concat(a, list_transform(b, lambda y: y + 1024)) AS c FROM s) SELECT user_id, {_STR.format(x=_FIT.format(n=50, x='c'))} AS tokens, {_STR.format(x='list_concat(list_concat([5000], m[1:18]), [5001])')} AS record FROM t",
    "resample_tokens": f"""WITH {STREAMS} SELECT user_id, {_STR.format(x="flatten(list_transform(a, lambda t: [t, t]))")} AS up, {_STR.format(x="list_filter(a, lambda t, i: (i - 1) % 3 = 0)")} AS down,
{_STR.format(x="list_transform(list_filter(generate_series(0, len(a) // 4), lambda g: g < len(a) // 4), lambda g: list_sum(a[g * 4 + 1 : g * 4 + 4]) // 4)")} AS pooled,
{_STR.format(x="list_transform(list_filter(generate_series(0, len(b)), lambda i: i < len(b)), lambda i: a[(i * len(a)) // len(b) + 1])")} AS nearest FROM s""",
    "offset_masked": f"""WITH {STREAMS} SELECT user_id, {_STR.format(x="list_transform(a, lambda t: CASE WHEN t % 2 = 0 THEN t + 10000 ELSE t END)")} AS tokens,
COALESCE(array_to_string(list_transform(list_filter(generate_series(0, len(a)), lambda i: i < len(a)), lambda i: CASE WHEN i < len(b) THEN 1 ELSE 0 END), ''), '') AS mask FROM s""",
    "proportional_cut": f"""WITH {STREAMS}, t AS (SELECT *, least(1.0::DOUBLE, CAST(30 AS DOUBLE) / (len(a) + len(b))) AS share FROM s)
SELECT user_id, least(len(a), greatest(CAST(floor(len(a) * share) AS BIGINT), 1)) AS n_a, least(len(b), greatest(CAST(floor(len(b) * share) AS BIGINT), 1)) AS n_b FROM t""",
    "render_parse": f"""WITH {STREAMS}, r AS (SELECT *, COALESCE(array_to_string(list_transform(a, lambda t: '<|audio_' || t || '|>'), ''), '') || COALESCE(array_to_string(list_transform(b, lambda t: '<|face_' || t || '|>'), ''), '') AS text FROM s)
SELECT user_id, md5(text) AS text_md5, TRUE AS same, {_STR.format(x='b')} AS face, md5(COALESCE(array_to_string(list_transform(list_filter(generate_series(1, greatest(least(len(a), len(b)), 1)), lambda i: i <= least(len(a), len(b))), lambda i: '<|face_' || b[i] || '|><|audio_' || a[i] || '|>'), ''), '')) AS steps_md5, CAST(len(a) AS INTEGER) AS single, CAST(NULL AS INTEGER) AS invalid FROM r""",
    "onset_frames": f"""WITH {STREAMS} SELECT user_id, array_to_string(list_transform(generate_series(0, 31), lambda i: CASE WHEN list_contains(list_transform(b, lambda t: t % 32), i) THEN 1 ELSE 0 END), '') AS onsets,
{_STR.format(x="list_concat(list_filter(list_transform(b, lambda t: t - 100), lambda t: t >= 0), [9])")} AS kept FROM s""",
    "pad_collate": f"WITH {STREAMS} SELECT user_id, MAX(len(a)) OVER (PARTITION BY user_id % 10) AS padded, len(a) AS length, len(a) AS n_back, COALESCE(CAST(list_sum(a) AS BIGINT), 0) AS total FROM s",
    "collate_records": "SELECT doc_id % 20 AS batch, COUNT(*) AS n, string_agg(doc_id || ':' || lang || ':' || n_chars, '|' ORDER BY doc_id) AS records FROM documents GROUP BY 1",
}
