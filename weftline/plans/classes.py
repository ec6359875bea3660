"""Word classes, turns about an axis, padding in every dimension, statistics of audio."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import rotations as R
from weftline.functions.words import CLASSES
from weftline.operators import corpus as C
from weftline.operators import features as V
from weftline.operators import metrics as M
from weftline.plans._tables import FRAMES, VECTORS, frames, r6, table, vectors

WORDS = ["walk", "the", "left", "unheard", "happy", "arm", "person", "chair", "run", "slowly", "of"]
TAGS = ["VERB", "NOUN", "XYZ", None, "DET"]
AXIS = (0.0, 0.6, 0.8)


def word_classes(spark, sf_dir):
    """Events as tagged words: the lexicon before the tag, OTHER for what is unknown."""
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), n.cast("int"))
    x = table(spark, sf_dir, "events").select("event_id", pick(WORDS, F.col("event_id") % len(WORDS)).alias("word"), pick(TAGS, F.col("user_id") % len(TAGS)).alias("tag"))
    known = spark.createDataFrame([(w,) for w in WORDS if w != "unheard"], "word string")
    return C.word_classes(x, known).select("event_id", "word", "word_class", F.array_position("class_vec", 1).alias("place"), F.size("class_vec").cast("long").alias("width"))


def quat_twist(spark, sf_dir):
    """Rotations as their twist about an axis and the swing before it."""
    q = R.normalize(F.slice("vec", 1, 4))
    x = vectors(spark, sf_dir).select("vec_id", R.twist(q, AXIS).alias("t"), R.swing(q, AXIS).alias("s"))
    return x.select("vec_id", *[r6(F.get(c, i)).alias(f"{c}{i}") for c in "ts" for i in range(4)])


def pad_levels(spark, sf_dir):
    """Ragged arrays of three levels, padded to the largest of their batch."""
    up_to = lambda n: F.sequence(F.lit(0), n.cast("int") - 1)
    i = F.col("vec_id")
    nested = F.transform(up_to(1 + i % 3), lambda a: F.transform(up_to(1 + (i + a) % 2), lambda b: F.transform(up_to(1 + (i + a + b) % 4), lambda c: F.get("vec", a * 12 + b * 4 + c))))
    v = vectors(spark, sf_dir).select("vec_id", (i % 40).alias("batch"), nested.alias("x"))
    p = V.pad_nested(v, "batch", "x", 3)
    flat = F.flatten(F.flatten("x"))
    last = F.element_at(F.element_at(F.element_at("x", -1), -1), -1)
    return p.select("vec_id", *[F.get("sizes", k).cast("long").alias(f"own{k}") for k in range(3)], F.size("x").cast("long").alias("d0"), F.size(F.get("x", 0)).cast("long").alias("d1"), F.size(F.get(F.get("x", 0), 0)).cast("long").alias("d2"), F.size(flat).cast("long").alias("n"), r6(F.aggregate(flat, F.lit(0.0), lambda s, y: s + y)).alias("total"), r6(last).alias("last"))


def audio_statistics(spark, sf_dir):
    """Users' values as clips: sums, squares and spectra of the whole corpus, and by parity of the user."""
    rows = F.array_sort(F.collect_list(F.struct("frame", "value")))
    clips = frames(spark, sf_dir).groupBy("seq_id").agg(F.transform(rows, lambda x: x["value"]).alias("samples"))
    clips = clips.withColumn("parity", F.col("seq_id") % 2)
    one = M.audio_statistics(clips, 8, 2, 8).withColumn("parity", F.lit(-1).cast("long"))
    both = one.unionByName(M.audio_statistics(clips, 8, 2, 8, key="parity"))
    return both.select("parity", "n_clips", "n_seen", *[F.round(c, 5).alias(c) for c in ("l1", "l2", "spec")])


QUERIES = {f.__name__: f for f in (word_classes, quat_twist, pad_levels, audio_statistics)}

_r = lambda x, n: f"round({x}, 6) + 0.0 AS {n}"
_list = lambda xs: "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in xs) + "]"
_NU = "(sqrt(w * w + k * k))"
_HANN = "[" + ", ".join(f"0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * {i} / 8)" for i in range(8)) + "]"
ORACLE = {
    "word_classes": f"""WITH e AS (SELECT event_id, {_list(WORDS)}[event_id % {len(WORDS)} + 1] AS word, {_list(TAGS)}[user_id % {len(TAGS)} + 1] AS tag FROM events),
c AS (SELECT event_id, word, CASE word WHEN 'unheard' THEN 'OTHER' WHEN 'walk' THEN 'Act_VIP' WHEN 'run' THEN 'Act_VIP' WHEN 'left' THEN 'Loc_VIP' WHEN 'happy' THEN 'Desc_VIP' WHEN 'slowly' THEN 'Desc_VIP' WHEN 'arm' THEN 'Body_VIP' WHEN 'chair' THEN 'Obj_VIP'
ELSE CASE WHEN tag IN ('VERB', 'NOUN', 'DET') THEN tag ELSE 'OTHER' END END AS word_class FROM e) SELECT event_id, word, word_class, CAST(list_position({_list(CLASSES)}, word_class) AS BIGINT) AS place, CAST(15 AS BIGINT) AS width FROM c""",
    "quat_twist": f"""WITH {VECTORS}, q AS (SELECT vec_id, list_transform(vec[1:4], lambda x: x / sqrt(vec[1]**2 + vec[2]**2 + vec[3]**2 + vec[4]**2)) AS q FROM vectors), k AS (SELECT *, q[1] AS w, 0.6::DOUBLE * q[3] + 0.8::DOUBLE * q[4] AS k FROM q),
t AS (SELECT *, w / {_NU} AS a, 0.6::DOUBLE * k / {_NU} AS c, 0.8::DOUBLE * k / {_NU} AS d FROM k)
SELECT vec_id, {_r('a', 't0')}, 0.0::DOUBLE AS t1, {_r('c', 't2')}, {_r('d', 't3')}, {_r('q[1]*a + q[3]*c + q[4]*d', 's0')}, {_r('q[2]*a - q[3]*d + q[4]*c', 's1')}, {_r('q[3]*a - q[1]*c + q[2]*d', 's2')}, {_r('q[4]*a - q[1]*d - q[2]*c', 's3')} FROM t""",
    "pad_levels": f"""WITH {VECTORS}, c AS (SELECT v.vec_id, v.vec_id % 40 AS batch, a.i AS a, b.i AS b, c.i AS c, v.vec[a.i * 12 + b.i * 4 + c.i + 1] AS x FROM vectors v, (SELECT unnest([0, 1, 2]) AS i) a, (SELECT unnest([0, 1]) AS i) b, (SELECT unnest([0, 1, 2, 3]) AS i) c
WHERE a.i <= v.vec_id % 3 AND b.i <= (v.vec_id + a.i) % 2 AND c.i <= (v.vec_id + a.i + b.i) % 4), o AS (SELECT vec_id, batch, MAX(a) + 1 AS own0, MAX(b) + 1 AS own1, MAX(c) + 1 AS own2, SUM(x) AS total FROM c GROUP BY ALL),
d AS (SELECT *, MAX(own0) OVER w AS d0, MAX(own1) OVER w AS d1, MAX(own2) OVER w AS d2 FROM o WINDOW w AS (PARTITION BY batch))
SELECT d.vec_id, CAST(own0 AS BIGINT) AS own0, CAST(own1 AS BIGINT) AS own1, CAST(own2 AS BIGINT) AS own2, CAST(d0 AS BIGINT) AS d0, CAST(d1 AS BIGINT) AS d1, CAST(d2 AS BIGINT) AS d2, CAST(d0 * d1 * d2 AS BIGINT) AS n, {_r('total', 'total')}, round(COALESCE(c.x, 0), 6) + 0.0 AS "last"
FROM d LEFT JOIN c ON c.vec_id = d.vec_id AND c.a = d0 - 1 AND c.b = d1 - 1 AND c.c = d2 - 1""",
    "audio_statistics": f"""WITH {FRAMES}, u AS (SELECT seq_id, list(value ORDER BY frame) AS x, COUNT(*) AS n FROM frames GROUP BY seq_id), f AS (SELECT seq_id, x, n, unnest(range(0, n // 2 + 1)) AS f FROM u),
g AS (SELECT seq_id, [x[CASE WHEN p < 0 THEN -p WHEN p >= n THEN 2 * (n - 1) - p ELSE p END + 1] FOR p IN [2 * f - 4 + j FOR j IN range(0, 8)]] AS y FROM f),
h AS (SELECT seq_id, [a[1] * a[2] FOR a IN list_zip(y, {_HANN})] AS y FROM g),
s AS (SELECT seq_id, sqrt(SUM((8 * list_sum([v * v FOR v IN y]) + list_sum(y) ** 2 + (y[1] - y[2] + y[3] - y[4] + y[5] - y[6] + y[7] - y[8]) ** 2) / 2)) AS spec FROM h GROUP BY seq_id),
t AS (SELECT u.seq_id, n, list_sum([abs(v) FOR v IN x]) AS a, list_sum(x) AS s, list_sum([v * v FOR v IN x]) AS q, spec FROM u JOIN s ON s.seq_id = u.seq_id), k AS (SELECT CAST(seq_id % 2 AS BIGINT) AS parity, * FROM t UNION ALL SELECT -1, * FROM t)
SELECT parity, COUNT(*) AS n_clips, CAST(SUM(n) AS BIGINT) AS n_seen, round(SUM(a) / SUM(n), 5) AS l1, round(SUM(q) / SUM(n) - (SUM(s) / SUM(n)) ** 2, 5) AS l2, round(AVG(spec), 5) AS spec FROM k GROUP BY parity""",
}
