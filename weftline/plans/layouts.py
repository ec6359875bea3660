"""Queries on token strings and masks: streams of a user as text, and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import layouts as L
from weftline.operators import tracks
from weftline.plans._tables import table
from weftline.plans.tokens import STREAMS, _joined, _streams

SIZE = 512


def layout_strings(spark, sf_dir):
    x = _streams(spark, sf_dir)
    a, b, n = F.col("a"), F.col("b"), F.least(F.size("a"), F.size("b"))
    texts = F.transform(b, lambda t: F.concat(F.lit("w"), (t % 9).cast("string")))
    both = {"face": a, "hand": b}
    made = {"bounded": L.bounded("motion", a, SIZE), "streams": L.stream_by_stream(both, n), "steps": L.step_by_step(both, n), "transcript": L.with_transcript(F.slice(a, 1, n), texts, SIZE), "spaced": L.spaced(b)}
    return x.select("user_id", *[F.md5(v).alias(k) for k, v in made.items()])


def layout_parse(spark, sf_dir):
    x = _streams(spark, sf_dir)
    even = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("say "), L.bounded("motion", F.col("a"), SIZE), F.lit(" now"))).otherwise(F.lit("no motion"))
    ids, rest = L.parse_middle(even, "motion", SIZE)
    mixed = F.concat(F.lit("<|audio_1|>text<|face_2|><|audio_"), F.size("a").cast("string"), F.lit("|><|hand_x|>"))
    found = L.parse_all(mixed, ["audio", "face", "hand"])
    return x.select("user_id", _joined(ids, "ids"), rest.alias("rest"), *[_joined(F.element_at(found, k), k) for k in ("audio", "face", "hand")])


def token_masks(spark, sf_dir):
    x = _streams(spark, sf_dir)
    head, rest = L.split_head(F.col("a"), 0.4)
    return x.select("user_id", _joined(L.mask_run(F.col("a"), 0.25, -7, F.col("user_id")), "masked"), _joined(head, "head"), _joined(rest, "rest"))


def noise_spans(spark, sf_dir):
    """Masks of noise: how many places and spans they have, and their sentinels."""
    x = _streams(spark, sf_dir).where(F.size("a") >= 4).select("user_id", F.size("a").alias("n"), L.noise_mask(F.size("a"), 0.3, 2.0, F.col("user_id")).alias("mask"))
    marks = L.sentinels(F.col("mask"), 100)
    x = x.select("user_id", "n", "mask", marks.alias("marks"))
    return x.select("user_id", F.col("n").cast("long").alias("n"), F.size(F.filter("mask", lambda m: m)).cast("long").alias("noise"), F.size(F.filter("marks", lambda m: m > 0)).cast("long").alias("spans"), F.size(F.filter("marks", lambda m: m == -1)).cast("long").alias("inside"), F.array_min(F.filter("marks", lambda m: m > 0)).cast("long").alias("last_mark"), F.get("mask", 0).alias("starts_noisy"))


def model_records(spark, sf_dir):
    x = _streams(spark, sf_dir)
    r = L.model_record(F.col("a"), F.col("b"), 24, upsample=2)
    q = L.model_record(F.col("a"), None, 24)
    x = x.select("user_id", r.alias("r"), q.alias("q"))
    return x.select("user_id", _joined(F.col("r.input_ids"), "ids"), _joined(F.col("q.input_ids"), "inference"), F.size("r.attention_mask").cast("long").alias("n"), F.array_max("r.position_ids").cast("long").alias("last"), F.array_max("r.token_type_ids").cast("long").alias("kinds"))


def split_restore(spark, sf_dir):
    x = _streams(spark, sf_dir)
    kinds = F.transform("a", lambda t: F.when(t % 3 == 0, "audio").when(t % 3 == 1, "face").otherwise("text"))
    x = x.select("user_id", "a", L.split_modalities(F.col("a"), kinds, ["text", "audio", "face"]).alias("parts"))
    tokens = lambda k: _joined(F.transform(F.element_at("parts", k), lambda p: F.concat(p["position"].cast("string"), F.lit(":"), p["token"].cast("string"))), k)
    return x.select("user_id", tokens("audio"), tokens("face"), (L.restore_order(F.col("parts")) == F.col("a")).alias("same"))


def length_filter(spark, sf_dir):
    return tracks.between_lengths(_streams(spark, sf_dir), "a", 30, 50).select("user_id", F.size("a").cast("long").alias("n"))


def trial_cap(spark, sf_dir):
    return tracks.first_rows(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], 25)


def sample_layout(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return tracks.layout(d, ["lang", "doc_id", "motion", "n_chars"], {"motion": F.lit("none")})


QUERIES = {f.__name__: f for f in (layout_strings, layout_parse, token_masks, noise_spans, model_records, split_restore, length_filter, trial_cap, sample_layout)}
_TAGS = "COALESCE(array_to_string(list_transform({x}, lambda t: '<{k}_id_' || t || '>'), ''), '')"
_STR = "COALESCE(array_to_string({x}, ','), '')"
_N = "n AS (SELECT *, least(len(a), len(b)) AS n FROM s)"
_MASKED = "CAST('0x' || substr(md5(CAST(user_id AS VARCHAR) || ':42'), 1, 8) AS BIGINT) % (len(a) - CAST(floor(len(a) * 0.25) AS BIGINT) + 1)"
ORACLE = {
    "layout_strings": f"""WITH {STREAMS}, {_N} SELECT user_id, md5('<motion_id_512>' || {_TAGS.format(x='a', k='motion')} || '<motion_id_513>') AS bounded,
md5('<motion_id_0>' || {_TAGS.format(x='a[1:n]', k='face')} || {_TAGS.format(x='b[1:n]', k='hand')} || '<motion_id_1>') AS streams,
md5('<motion_id_0>' || COALESCE(array_to_string(list_transform(list_filter(generate_series(1, n + 1), lambda i: i <= n), lambda i: '<face_id_' || a[i] || '><hand_id_' || b[i] || '>'), ''), '') || '<motion_id_1>') AS steps,
md5('<audio_id_515>' || COALESCE(array_to_string(list_transform(list_filter(generate_series(1, n + 1), lambda i: i <= n), lambda i: '<audio_id_' || a[i] || '>w' || (b[i] % 9)), ''), '') || '<audio_id_516>') AS transcript,
md5(COALESCE(array_to_string(list_transform(b, lambda t: '[atoken' || t || ']'), ' '), '')) AS spaced FROM n""",
    "layout_parse": f"""WITH {STREAMS} SELECT user_id, CASE WHEN user_id % 2 = 0 AND len(a) > 0 THEN array_to_string(a, ',') ELSE '0' END AS ids,
CASE WHEN user_id % 2 = 0 THEN 'say <Motion_Placeholder> now' ELSE 'no motion' END AS rest, '1,' || len(a) AS audio, '2' AS face, '' AS hand FROM s""",
    "token_masks": f"""WITH {STREAMS}, m AS (SELECT *, {_MASKED} AS k, CAST(floor(len(a) * 0.25) AS BIGINT) AS w, CAST(floor(len(a) * 0.4 + 1) AS BIGINT) AS h FROM s)
SELECT user_id, {_STR.format(x='list_transform(a, lambda t, i: CASE WHEN i > k AND i <= k + w THEN -7 ELSE t END)')} AS masked, {_STR.format(x='a[1:h]')} AS head, {_STR.format(x='a[h + 1:]')} AS rest FROM m""",
    "noise_spans": f"""WITH {STREAMS}, a AS (SELECT user_id, len(a) AS n, CAST(least(greatest(round_even(len(a) * 0.3, 0), 1), len(a) - 1) AS BIGINT) AS noise FROM s WHERE len(a) >= 4),
b AS (SELECT *, CAST(greatest(round_even(noise / 2.0, 0), 1) AS BIGINT) AS spans FROM a) SELECT user_id, n, noise, spans, noise - spans AS inside, 100 - spans AS last_mark, FALSE AS starts_noisy FROM b""",
    "model_records": f"""WITH {STREAMS}, u AS (SELECT *, flatten(list_transform(b, lambda t: [t, t])) AS b2 FROM s), c AS (SELECT *, list_filter(flatten(list_transform(generate_series(1, greatest(len(a), len(b2))), lambda i: [a[i], b2[i] + 1024])), lambda v: v IS NOT NULL)[1:22] AS m FROM u)
SELECT user_id, {_STR.format(x='list_concat(list_concat([1], m), [2])')} AS ids, {_STR.format(x='list_concat(list_concat([1], a[1:12]), [2])')} AS inference, len(m) + 2 AS n, len(m) + 1 AS last, CAST(0 AS BIGINT) AS kinds FROM c""",
    "split_restore": f"""WITH {STREAMS}, p AS (SELECT user_id, list_filter(list_transform(a, lambda t, i: CASE WHEN t % 3 = 0 THEN (i - 1) || ':' || t END), lambda v: v IS NOT NULL) AS x, list_filter(list_transform(a, lambda t, i: CASE WHEN t % 3 = 1 THEN (i - 1) || ':' || t END), lambda v: v IS NOT NULL) AS y FROM s)
SELECT user_id, {_STR.format(x='x')} AS audio, {_STR.format(x='y')} AS face, TRUE AS same FROM p""",
    "length_filter": f"WITH {STREAMS} SELECT user_id, len(a) AS n FROM s WHERE len(a) BETWEEN 30 AND 50",
    "trial_cap": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 25",
    "sample_layout": "SELECT lang, doc_id, 'none' AS motion, n_chars FROM documents",
}
