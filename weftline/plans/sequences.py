"""Clips, kinematics and alignment over users' event sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import align, clips
from weftline.operators import kinematics as K
from weftline.plans._tables import FRAMES, frames, lengths, r6, table

N = "n AS (SELECT user_id AS seq_id, COUNT(*) AS n FROM events GROUP BY 1)"
W = "PARTITION BY seq_id ORDER BY frame"


def clip_slices(spark, sf_dir):
    return clips.clip_slices(lengths(spark, sf_dir), 5, 20, 7)


def clip_slices_test(spark, sf_dir):
    return clips.clip_slices(lengths(spark, sf_dir), 5, train=False)


def segment_or_whole(spark, sf_dir):
    return clips.segments_or_whole(lengths(spark, sf_dir), 60, 15)


def paired_chunks(spark, sf_dir):
    n = lengths(spark, sf_dir)
    a = clips.paired_chunks(n, 26, True).withColumn("kind", F.lit("train"))
    b = clips.paired_chunks(n, 26, False).withColumn("kind", F.lit("test"))
    return a.union(b).union(clips.paired_chunks(n, 26, True, True).withColumn("kind", F.lit("inclusive")))


def cross_rate(spark, sf_dir):
    return clips.cross_rate(clips.clip_slices(lengths(spark, sf_dir), 5, 20, 7), 16000, 30)


def fixed_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.col("n_chars").alias("n"))
    return clips.fixed_chunks(docs, 800, 400)


def restitch_chunks(spark, sf_dir):
    f = frames(spark, sf_dir)
    part = f.groupBy("seq_id", F.floor(F.col("frame") / 16).alias("clip")).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "event_id"))), lambda x: x["event_id"]).alias("values"))
    return clips.restitch(part).select("seq_id", F.md5(F.array_join(F.transform("values", lambda v: v.cast("string")), ",")).alias("values_md5"))


def keep_every_k(spark, sf_dir):
    return clips.every_kth(frames(spark, sf_dir), 4, drop_last=True).select("seq_id", "frame", "event_id")


def velocity_central(spark, sf_dir):
    return frames(spark, sf_dir).select("seq_id", "frame", r6(K.velocity(dt=0.5)).alias("velocity"), r6(K.delta()).alias("delta"))


def integrate(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f.select("seq_id", "frame", F.round(K.integrate(), 4).alias("total"), F.round(K.position(dt=0.5, start=1.0), 4).alias("position"), K.floor_height().alias("floor"))


def contact_flags(spark, sf_dir):
    return frames(spark, sf_dir).select("seq_id", "frame", K.contact(threshold=2.0).alias("contact"))


def contact_features(spark, sf_dir):
    return K.contact_features(frames(spark, sf_dir), threshold=4.0).select("seq_id", "frame", "contact")


def local_minima(spark, sf_dir):
    return K.local_minima(frames(spark, sf_dir), 2, least=0.5).select("seq_id", "frame", "value")


def envelope(spark, sf_dir):
    x = frames(spark, sf_dir).select("seq_id", "frame", K.envelope(size=8).alias("peak"))
    return x.select("seq_id", "frame", K.fill_tail("peak").alias("peak"))


def blank_fill(spark, sf_dir):
    x = frames(spark, sf_dir).withColumn("value", F.when(F.col("event_type") == "view", F.col("value")))
    return x.select("seq_id", "frame", K.fill_left().alias("value"))


def gaussian_smooth(spark, sf_dir):
    return frames(spark, sf_dir).select("seq_id", "frame", r6(K.gaussian(sigma=1.0)).alias("smooth"))


def sentinel_runs(spark, sf_dir):
    x = frames(spark, sf_dir).withColumn("mask", (F.col("event_type") == "click").cast("int"))
    return x.select("seq_id", "frame", K.run_numbers(F.col("mask")).alias("run"))


def quat_continuity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = F.slice(F.col("embedding").cast("array<double>"), 1, 4)
    x = K.quaternion_continuity(e.select((F.col("vec_id") % 8).alias("seq_id"), F.col("vec_id").alias("frame"), q.alias("q")))
    return x.select("seq_id", "frame", *[r6(F.get("q", i)).alias(f"q{i}") for i in range(4)])


def _intervals(f):
    """Every fourth event of a user opens an interval of three time units."""
    return f.where("frame % 4 = 1").select("seq_id", F.col("frame").alias("idx"), F.col("frame").cast("double").alias("start"), (F.col("frame") + 5).cast("double").alias("stop"), F.col("event_type").alias("mark"), "value")


_IV = "iv AS (SELECT seq_id, frame AS idx, CAST(frame AS DOUBLE) AS start, CAST(frame + 5 AS DOUBLE) AS stop, event_type AS mark, value FROM frames WHERE frame % 4 = 1)"


def interval_first_match(spark, sf_dir):
    f = frames(spark, sf_dir)
    points = f.select("seq_id", (F.col("frame") + 0.5).cast("double").alias("t"))
    return align.first_interval(points, _intervals(f), "mark", 8.0)


def span_default(spark, sf_dir):
    f = frames(spark, sf_dir)
    return align.first_interval(f.select("seq_id", F.col("frame").cast("double").alias("t")), _intervals(f).where("value > 20"), "value", 8.0, 0.0)


def span_containment(spark, sf_dir):
    f = frames(spark, sf_dir)
    c = clips.clip_slices(lengths(spark, sf_dir), 5, 20, 7)
    return align.contained_words(c, _intervals(f).select("seq_id", "idx", "mark", "start", "stop"), 16.0)


def nearest_beat(spark, sf_dir):
    f = frames(spark, sf_dir)
    a = f.where("event_type = 'click'").select("seq_id", F.col("frame").cast("double").alias("t"))
    b = f.where("event_type = 'view'").select("seq_id", F.col("frame").cast("double").alias("t"))
    return align.nearest(a, b)


def beat_align(spark, sf_dir):
    f = frames(spark, sf_dir)
    a = f.where("event_type = 'click'").select("seq_id", F.col("frame").cast("double").alias("t"))
    b = f.where("event_type = 'view'").select("seq_id", F.col("frame").cast("double").alias("t"))
    return align.beat_alignment(a, b, 3.0).select("seq_id", r6(F.col("score")).alias("score"))


def beat_align_joints(spark, sf_dir):
    """Beats of three joints against one reference, averaged over the joints."""
    f = frames(spark, sf_dir).withColumn("t", F.col("frame").cast("double"))
    b = f.where("event_type = 'view'").select("seq_id", (F.col("event_id") % 3).alias("joint"), "t")
    x = align.beat_alignment_of_joints(f.where("event_type = 'click'").select("seq_id", "t"), b, 3.0)
    return x.select("seq_id", r6(F.col("score")).alias("score"))


def subword_spans(spark, sf_dir):
    """All words of a text, and pieces of three characters inside them."""
    from weftline.functions.tokens import words

    d = table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("words"))
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / 3).cast("int")), lambda k: w.substr(k * 3 + 1, F.lit(3)))
    return align.pieces_in_words(d.select("doc_id", "words", F.flatten(F.transform("words", cut)).alias("pieces")))


def subdivision(spark, sf_dir):
    f = _intervals(frames(spark, sf_dir))
    return f.select("seq_id", "idx", align.subdivision(F.col("start") + F.pmod(F.col("idx"), F.lit(5)) + 0.25, F.col("start"), F.col("stop"), F.lit(3)).alias("part"))


QUERIES = {f.__name__: f for f in (clip_slices, clip_slices_test, segment_or_whole, paired_chunks, cross_rate, fixed_chunks, restitch_chunks, keep_every_k, velocity_central, integrate, contact_flags, contact_features, local_minima, envelope, blank_fill, gaussian_smooth, sentinel_runs, quat_continuity, interval_first_match, span_default, span_containment, nearest_beat, beat_align, beat_align_joints, subword_spans, subdivision)}
_CLIPS = "L AS (SELECT seq_id, CASE WHEN n < 5 THEN 5 ELSE n // 5 * 5 END AS l FROM n), c AS (SELECT seq_id, CAST(floor((l - 20) / 7) AS INTEGER) + 1 AS k FROM L), clips AS (SELECT seq_id, CAST(unnest(generate_series(0, k - 1)) AS INTEGER) AS clip FROM c WHERE k > 0), cl AS (SELECT seq_id, clip, clip * 7 AS start, clip * 7 + 20 AS stop FROM clips)"
_PC = "SELECT seq_id, CAST(unnest(generate_series(0, {k} - 1)) AS INTEGER) AS clip, {st} AS stride, '{kind}' AS kind FROM n WHERE n >= 26 AND {k} > 0"
_GW = [2.718281828459045 ** (-0.5 * i * i) for i in range(-4, 5)]
_NEAR = """a AS (SELECT seq_id, CAST(frame AS DOUBLE) AS t FROM frames WHERE event_type = 'click'), b AS (SELECT seq_id, CAST(frame AS DOUBLE) AS t FROM frames WHERE event_type = 'view'),
d AS (SELECT a.seq_id, a.t, MIN(abs(a.t - b.t)) AS distance FROM a LEFT JOIN b ON a.seq_id = b.seq_id GROUP BY a.seq_id, a.t)"""
_DW = r"list_filter(string_split_regex(translate(text, ',.?!', '    '), '[ \t\n\v\f\r]+'), lambda w: len(w) > 0)"
ORACLE = {
    "clip_slices": f"WITH {N}, {_CLIPS} SELECT * FROM cl",
    "clip_slices_test": f"WITH {N} SELECT seq_id, 0 AS clip, 0 AS start, CAST(CASE WHEN n < 5 THEN 5 ELSE n // 5 * 5 END AS INTEGER) AS stop FROM n",
    "segment_or_whole": f"""WITH {N}, k AS (SELECT *, CASE WHEN n > 60 THEN (n - 60) // 15 + 1 ELSE 1 END AS k FROM n), x AS (SELECT seq_id, n, CAST(unnest(generate_series(0, k - 1)) AS INTEGER) AS clip FROM k)
SELECT seq_id, clip, clip * 15 AS start, CASE WHEN n > 60 THEN clip * 15 + 60 ELSE n END AS stop FROM x""",
    "paired_chunks": f"""WITH {N}, x AS ({_PC.format(k='CAST(ceil((n - 26) / 13.0) AS INTEGER)', st=13, kind='train')} UNION ALL {_PC.format(k='CAST(ceil((n - 26) / 26.0) AS INTEGER)', st=26, kind='test')} UNION ALL {_PC.format(k='((n - 26) // 13 + 1)', st=13, kind='inclusive')})
SELECT seq_id, clip, clip * stride AS start, clip * stride + 26 AS stop, clip * stride // 2 AS slow_start, clip * stride // 2 + 13 AS slow_stop, kind FROM x""",
    "cross_rate": f"WITH {N}, {_CLIPS} SELECT *, CAST(floor(start * 16000 / 30.0) AS BIGINT) AS other_start, CAST(floor((stop - start) / 30.0 * 16000) AS BIGINT) AS other_len FROM cl",
    "fixed_chunks": """WITH x AS (SELECT doc_id AS seq_id, n_chars AS n, CAST(unnest(generate_series(0, CAST(ceil(n_chars / 800.0) AS BIGINT) - 1)) AS INTEGER) AS clip FROM documents WHERE n_chars > 0)
SELECT seq_id, clip, clip * 800 AS start, least(clip * 800 + 800, n) AS stop FROM x WHERE least(clip * 800 + 800, n) - clip * 800 >= 400""",
    "restitch_chunks": f"WITH {FRAMES} SELECT seq_id, md5(string_agg(event_id, ',' ORDER BY frame)) AS values_md5 FROM frames GROUP BY 1",
    "keep_every_k": f"WITH {FRAMES}, l AS (SELECT *, MAX(frame) OVER (PARTITION BY seq_id) AS last FROM frames) SELECT seq_id, frame, event_id FROM l WHERE frame % 4 = 0 AND frame < last",
    "velocity_central": f"""WITH {FRAMES}, x AS (SELECT seq_id, frame, value AS v, lag(value) OVER ({W}) AS a, lead(value) OVER ({W}) AS b FROM frames)
SELECT seq_id, frame, round(CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN a IS NULL THEN (b - v) / 0.5 WHEN b IS NULL THEN (v - a) / 0.5 ELSE (b - a) / 1.0 END, 6) + 0.0 AS velocity, round(v - COALESCE(a, v), 6) + 0.0 AS delta FROM x""",
    "integrate": f"""WITH {FRAMES} SELECT seq_id, frame, round(SUM(value) OVER ({W} ROWS UNBOUNDED PRECEDING), 4) AS total,
round(1.0::DOUBLE + 0.5::DOUBLE * COALESCE(SUM(value) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS position, MIN(value) OVER (PARTITION BY seq_id) AS floor FROM frames""",
    "contact_flags": f"WITH {FRAMES} SELECT seq_id, frame, CASE WHEN COALESCE(abs(lead(value) OVER ({W}) - value), 0) < 2 THEN 1 ELSE 0 END AS contact FROM frames",
    "contact_features": f"WITH {FRAMES}, x AS (SELECT seq_id, frame, lead(value) OVER ({W}) - value AS d FROM frames) SELECT seq_id, frame, CASE WHEN d * d < 4 THEN 1 ELSE 0 END AS contact FROM x WHERE d IS NOT NULL",
    "local_minima": f"""WITH {FRAMES}, x AS (SELECT seq_id, frame, value, MIN(value) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS a, MIN(value) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS b FROM frames)
SELECT seq_id, frame, value FROM x WHERE value < a AND value < b AND value > 0.5""",
    "envelope": f"""WITH {FRAMES}, x AS (SELECT seq_id, frame, CASE WHEN COUNT(*) OVER ({W} ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) = 8 THEN MAX(abs(value)) OVER ({W} ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) END AS p FROM frames)
SELECT seq_id, frame, COALESCE(p, last_value(p IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING)) AS peak FROM x""",
    "blank_fill": f"""WITH {FRAMES}, x AS (SELECT seq_id, frame, CASE WHEN event_type = 'view' THEN value END AS v FROM frames)
SELECT seq_id, frame, COALESCE(last_value(v IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), last_value(v IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS value FROM x""",
    "gaussian_smooth": f"WITH {FRAMES} SELECT seq_id, frame, round(" + " + ".join(f"COALESCE({'lead' if i > 0 else 'lag'}(value, {abs(i)}) OVER ({W}), 0) * {w / sum(_GW)!r}::DOUBLE" for i, w in zip(range(-4, 5), _GW, strict=True)) + ", 6) + 0.0 AS smooth FROM frames",
    "sentinel_runs": f"""WITH {FRAMES}, x AS (SELECT seq_id, frame, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS m FROM frames), y AS (SELECT *, CASE WHEN m = 1 AND COALESCE(lag(m) OVER ({W}), 0) = 0 THEN 1 ELSE 0 END AS s FROM x)
SELECT seq_id, frame, CASE WHEN m = 1 THEN CAST(SUM(s) OVER ({W}) AS BIGINT) END AS run FROM y""",
    "quat_continuity": f"""WITH e AS (SELECT vec_id % 8 AS seq_id, vec_id AS frame, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings),
d AS (SELECT *, list_sum(list_transform(list_zip(q, lag(q) OVER ({W})), lambda z: z[1] * z[2])) AS dot FROM e), s AS (SELECT *, SUM(CASE WHEN dot < 0 THEN 1 ELSE 0 END) OVER ({W}) % 2 AS f FROM d)
SELECT seq_id, frame, """ + ", ".join(f"round(CASE WHEN f = 1 THEN -q[{i + 1}] ELSE q[{i + 1}] END, 6) + 0.0 AS q{i}" for i in range(4)) + " FROM s",
    "interval_first_match": f"""WITH {FRAMES}, {_IV}, p AS (SELECT seq_id, CAST(frame + 0.5 AS DOUBLE) AS t FROM frames)
SELECT p.seq_id, p.t, arg_min(iv.mark, iv.idx) AS mark FROM p LEFT JOIN iv ON p.seq_id = iv.seq_id AND p.t BETWEEN iv.start AND iv.stop GROUP BY ALL""",
    "span_default": f"""WITH {FRAMES}, {_IV}, p AS (SELECT seq_id, CAST(frame AS DOUBLE) AS t FROM frames)
SELECT p.seq_id, p.t, COALESCE(arg_min(iv.value, iv.idx), 0.0) AS value FROM p LEFT JOIN (SELECT * FROM iv WHERE value > 20) iv ON p.seq_id = iv.seq_id AND p.t BETWEEN iv.start AND iv.stop GROUP BY p.seq_id, p.t""",
    "span_containment": f"""WITH {FRAMES}, {_IV}, {N}, {_CLIPS}
SELECT cl.seq_id, cl.clip, COALESCE(string_agg(iv.mark, ' ' ORDER BY iv.idx), '') AS words, COUNT(iv.idx) AS n_words FROM cl LEFT JOIN iv ON cl.seq_id = iv.seq_id AND iv.start >= cl.start AND iv.stop <= cl.stop GROUP BY cl.seq_id, cl.clip""",
    "nearest_beat": f"WITH {FRAMES}, {_NEAR} SELECT * FROM d",
    "beat_align_joints": f"""WITH {FRAMES}, d AS (SELECT r.seq_id, r.frame, j.joint, MIN(abs(b.frame - r.frame)) AS d FROM frames r CROSS JOIN (SELECT unnest([0, 1, 2]) AS joint) j
LEFT JOIN frames b ON b.seq_id = r.seq_id AND b.event_type = 'view' AND b.event_id % 3 = j.joint WHERE r.event_type = 'click' GROUP BY ALL),
k AS (SELECT seq_id, joint, AVG(COALESCE(exp(-(d * d) / 18.0), 0)) AS s FROM d GROUP BY ALL) SELECT seq_id, round(AVG(s), 6) + 0.0 AS score FROM k GROUP BY seq_id""",
    "beat_align": f"WITH {FRAMES}, {_NEAR} SELECT seq_id, round(AVG(COALESCE(exp(-(distance * distance) / 18.0), 0)), 6) + 0.0 AS score FROM d GROUP BY 1",
    "subword_spans": f"""WITH a AS (SELECT doc_id, {_DW} AS ws FROM documents), b AS (SELECT doc_id, CAST(unnest(generate_series(0, len(ws) - 1)) AS INTEGER) AS idx, unnest(ws) AS w FROM a)
SELECT doc_id, idx, substr(w, k * 3 + 1, 3) AS piece, CAST(k AS INTEGER) AS at FROM (SELECT doc_id, idx, w, unnest(generate_series(0, (len(w) - 1) // 3)) AS k FROM b)""",
    "subdivision": f"WITH {FRAMES}, {_IV} SELECT seq_id, idx, CAST(greatest(least(ceil((idx % 5 + 0.25) / (5.0 / 3)) - 1, 2), 0) AS BIGINT) AS part FROM iv",
}
