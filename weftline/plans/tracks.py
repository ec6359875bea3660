"""Motion tracks, more kinematics and more metrics over users' events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import codes, features, tracks
from weftline.operators import kinematics as K
from weftline.operators import metrics as M
from weftline.plans._tables import DIST, FRAMES, VECTORS, frames, r6, vectors
from weftline.plans.vectors import PAIRS, _pairs

CHANNELS = ["Hips_Xposition", "Hips_Yposition", "Hips_Zposition", "LeftFoot_Xposition", "LeftFoot_Zposition", "RightHand_Xrotation"]


def _tracks(spark, sf_dir):
    """Ten vectors as the frames of a track, six components as channels, and a constant one."""
    cells = F.array(*[F.struct(F.lit(c).alias("channel"), F.get("vec", i).alias("value")) for i, c in enumerate(CHANNELS)], F.struct(F.lit("Spine_Xrotation").alias("channel"), F.lit(2.5).alias("value")))
    x = vectors(spark, sf_dir, 6).select(F.floor(F.col("vec_id") / 10).alias("track"), (F.col("vec_id") % 10).alias("frame"), F.explode(cells).alias("c"))
    return x.select("track", "frame", "c.*")


def _rounded(rows):
    return rows.select("track", "frame", "channel", r6(F.col("value")).alias("value"))


def joint_select(spark, sf_dir):
    return _rounded(tracks.select_joints(_tracks(spark, sf_dir), ["Foot"], "Hips"))


def group_filter(spark, sf_dir):
    return _rounded(tracks.without_groups(_tracks(spark, sf_dir), ["Leg", "Foot", "Toe", "Hand"]))


def constants_restore(spark, sf_dir):
    """Constant channels of the first track go, and come back with its value."""
    x = _tracks(spark, sf_dir)
    constants = tracks.constant_values(x, 0)
    left = tracks.remove_channels(x, constants)
    back = tracks.restore_channels(left, constants).groupBy("channel").agg(F.count("*").alias("n_restored"), r6(F.sum("value")).alias("total"))
    return back.join(left.groupBy("channel").agg(F.count("*").alias("n_left")), "channel", "left").select("channel", F.coalesce("n_left", F.lit(0)).alias("n_left"), "n_restored", "total")


def root_deltas(spark, sf_dir):
    return _rounded(tracks.root_deltas(_tracks(spark, sf_dir), "Hips"))


def root_restore(spark, sf_dir):
    return _rounded(tracks.root_positions(tracks.root_deltas(_tracks(spark, sf_dir), "Hips"), "Hips", {"X": 1.0, "Z": -1.0}))


def root_centred(spark, sf_dir):
    x = tracks.centred(_tracks(spark, sf_dir), "Hips")
    back = tracks.centred(x, "Hips", inverse=True).select("track", "frame", "channel", F.col("value").alias("back"))
    return x.join(back, ["track", "frame", "channel"]).select("track", "frame", "channel", r6(F.col("value")).alias("value"), r6(F.col("back")).alias("back"))


def track_union(spark, sf_dir):
    """Tracks of two sources as one, with their frames as arrays."""
    x = _tracks(spark, sf_dir)
    both = tracks.concat_tracks(x, x.where("track = 0").withColumn("track", F.lit(-1).cast("long")))
    return tracks.to_arrays(both).select("track", "frame", F.size("vec").cast("long").alias("width"), *[r6(F.get("vec", i)).alias(f"v{i}") for i in (0, 3, 6)])


def joint_speed(spark, sf_dir):
    v = vectors(spark, sf_dir, 12)
    joints = F.array(*[F.struct(F.lit(j).alias("joint"), *[F.get("vec", 3 * j + k).alias(c) for k, c in enumerate("xyz")]) for j in range(4)])
    x = v.select(F.floor(F.col("vec_id") / 16).alias("seq_id"), (F.col("vec_id") % 16).alias("frame"), F.explode(joints).alias("j")).select("seq_id", "frame", "j.*")
    return tracks.joint_speeds(x, 0.5).select("joint", r6(F.col("speed")).alias("speed"))


def floor_softmin(spark, sf_dir):
    return frames(spark, sf_dir).select("seq_id", "frame", r6(F.col("value") / 100).alias("value")).select("seq_id", r6(K.softmin_height()).alias("floor")).distinct()


def frames_doubled(spark, sf_dir):
    return K.doubled(frames(spark, sf_dir).select("seq_id", "frame", "value")).select("seq_id", "frame", r6(F.col("value")).alias("value"))


def frames_blended(spark, sf_dir):
    """A user's frames followed by the same ones again, over four frames."""
    f = frames(spark, sf_dir).select("seq_id", "frame", "value")
    return K.blended(f, f, 4).select("seq_id", "frame", r6(F.col("value")).alias("value"))


def contact_steps(spark, sf_dir):
    return K.contact_steps(frames(spark, sf_dir).select("seq_id", "frame", "value"), apart=5)


def vertex_error(spark, sf_dir):
    return M.vertex_error(_pairs(spark, sf_dir)).select("seq_id", r6(F.col("mpvpe")).alias("mpvpe"))


def loss_means(spark, sf_dir):
    p = _pairs(spark, sf_dir).select(F.abs(F.get("pred", 0) - F.get("truth", 0)).alias("l1"), F.pow(F.get("pred", 0) - F.get("truth", 0), 2).alias("l2"))
    return M.loss_means(p, ["l1", "l2"]).select(*[r6(F.col(c)).alias(c) for c in ("l1", "l2", "total")])


def batch_distances(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("batch", F.floor(F.col("vec_id") / 8))
    return M.block_distances(v, v, "batch").select("batch", "i", "j", F.round("d", 5).alias("d"))


def prefix_variance(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", r6(M.variance_to(F.col("vec"), (F.col("vec_id") % 60 + 2).cast("int"))).alias("variance"))


def label_quota(spark, sf_dir):
    return M.label_multimodality(vectors(spark, sf_dir), 10).select(r6(F.col("multimodality")).alias("multimodality"), "n_labels")


def corpus_rates(spark, sf_dir):
    from weftline.plans._tables import table

    d = table(spark, sf_dir, "documents").select(F.col("n_chars").alias("bytes"), (F.col("doc_id") % 7 + 1).cast("double").alias("seconds"))
    x = M.chunk_statistics(d, {"of_wide": 256_000.0, "of_narrow": 64_000.0})
    return x.select("n_chunks", *[r6(F.col(c)).alias(c) for c in ("mean_bytes", "bits_per_second", "of_wide", "of_narrow")])


def mask_overlap(spark, sf_dir):
    v = vectors(spark, sf_dir)
    bits = lambda a: F.transform(F.slice("vec", a, 32), lambda x: (x > 0.05).cast("int"))
    p = F.get("vec", 0) / 4 + 0.5
    return v.select("vec_id", r6(features.mask_iou(bits(1), bits(33))).alias("iou"), r6(features.kl_normal(F.get("vec", 0), F.get("vec", 1))).alias("kl"), r6(features.cross_entropy(p, (F.col("vec_id") % 2).cast("double"))).alias("bce"))


def renormalized(spark, sf_dir):
    v = vectors(spark, sf_dir, 4)
    old, new = features.channel_statistics(v.where("label < 5")), features.channel_statistics(v)
    return features.renormalize(v.select("vec_id", "vec"), old, new).select("vec_id", *[r6(F.get("vec", i)).alias(f"v{i}") for i in range(4)])


def codes_replaced(spark, sf_dir):
    """Codes that fall below one use take vectors of the data as their values."""
    v = vectors(spark, sf_dir, 4)
    book = v.where("vec_id < 6").select(F.col("vec_id").alias("code"), F.posexplode("vec").alias("i", "value")).select("code", "i", F.lit(1.0).alias("count"), F.col("value").alias("total"), "value")
    used = v.where("vec_id % 2 = 0").select(F.col("vec_id").alias("code"), "vec").where("code < 6")
    new = codes.replaced(codes.ema_update(book, used, 0.5), v)
    return new.select("code", "i", r6(F.col("value")).alias("value"), "is_replaced")


def bit_scales(spark, sf_dir):
    v = vectors(spark, sf_dir, 8).select(F.floor(F.col("vec_id") / 10).alias("seq_id"), (F.col("vec_id") % 10).alias("frame"), "vec")
    return codes.scale_bits(v, [1, 2, 5])


QUERIES = {f.__name__: f for f in (joint_select, group_filter, constants_restore, root_deltas, root_restore, root_centred, track_union, joint_speed, floor_softmin, frames_doubled, frames_blended, contact_steps, vertex_error, loss_means, batch_distances, prefix_variance, label_quota, corpus_rates, mask_overlap, renormalized, codes_replaced, bit_scales)}
_T = f"{VECTORS}, t AS (SELECT vec_id // 10 AS track, vec_id % 10 AS frame, unnest([{', '.join(repr(c) for c in CHANNELS)}, 'Spine_Xrotation']) AS channel, unnest([{', '.join(f'vec[{i + 1}]' for i in range(6))}, 2.5::DOUBLE]) AS value FROM vectors)"
_r = lambda x, n="value", k=6: f"round({x}, {k}) + 0.0 AS {n}"
_W = "PARTITION BY track, channel ORDER BY frame"
_MOVED = "channel IN ('Hips_Xposition', 'Hips_Zposition')"
_F = f"{FRAMES}, f AS (SELECT seq_id, frame, value FROM frames)"
_P = "PARTITION BY seq_id ORDER BY frame"
_STD = ", ".join(f"AVG(vec[{i}]) AS m{i}, stddev_pop(vec[{i}]) AS s{i}" for i in range(1, 5))
ORACLE = {
    "joint_select": f"WITH {_T} SELECT track, frame, channel, {_r('value')} FROM t WHERE channel LIKE '%Foot%' OR channel LIKE '%Hips%'",
    "group_filter": f"WITH {_T} SELECT track, frame, channel, {_r('value')} FROM t WHERE channel NOT LIKE '%Foot%' AND channel NOT LIKE '%Hand%'",
    "constants_restore": f"WITH {_T} SELECT channel, CASE WHEN channel = 'Spine_Xrotation' THEN 0 ELSE COUNT(*) END AS n_left, COUNT(*) AS n_restored, {_r('SUM(value)', 'total')} FROM t GROUP BY channel",
    "root_deltas": f"""WITH {_T} SELECT track, frame, CASE WHEN {_MOVED} THEN replace(replace(channel, '_X', '_dX'), '_Z', '_dZ') ELSE channel END AS channel,
{_r(f"CASE WHEN {_MOVED} THEN value - COALESCE(lag(value) OVER ({_W}), value) ELSE value END")} FROM t""",
    "root_restore": f"""WITH {_T} SELECT track, frame, channel, {_r(f"CASE WHEN channel = 'Hips_Xposition' THEN 1 + value - first(value) OVER ({_W}) WHEN channel = 'Hips_Zposition' THEN -1 + value - first(value) OVER ({_W}) ELSE value END")} FROM t""",
    "root_centred": f"""WITH {_T} SELECT a.track, a.frame, a.channel, {_r("a.value - CASE WHEN a.channel LIKE 'LeftFoot%' THEN r.value ELSE 0 END")}, {_r('a.value', 'back')}
FROM t a LEFT JOIN t r ON r.track = a.track AND r.frame = a.frame AND r.channel = replace(a.channel, 'LeftFoot', 'Hips')""",
    "track_union": f"""WITH {_T}, u AS (SELECT * FROM t UNION ALL SELECT -1, frame, channel, value FROM t WHERE track = 0), l AS (SELECT track, frame, list(value ORDER BY channel) AS v FROM u GROUP BY ALL)
SELECT track, frame, len(v) AS width, {_r('v[1]', 'v0')}, {_r('v[4]', 'v3')}, {_r('v[7]', 'v6')} FROM l""",
    "joint_speed": f"""WITH {VECTORS}, j AS (SELECT vec_id // 16 AS s, vec_id % 16 AS f, unnest([0, 1, 2, 3]) AS joint, unnest([vec[1:3], vec[4:6], vec[7:9], vec[10:12]]) AS p FROM vectors),
n AS (SELECT *, lag(p) OVER w AS a, lead(p) OVER w AS b FROM j WINDOW w AS (PARTITION BY s, joint ORDER BY f)),
v AS (SELECT joint, CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN a IS NULL THEN {DIST.format(a='b', b='p')} / 0.5 WHEN b IS NULL THEN {DIST.format(a='p', b='a')} / 0.5 ELSE {DIST.format(a='b', b='a')} END AS v FROM n)
SELECT joint, {_r('AVG(v)', 'speed')} FROM v GROUP BY joint""",
    "floor_softmin": f"WITH {_F}, g AS (SELECT seq_id, round(value / 100, 6) AS v FROM f) SELECT seq_id, {_r('MIN(v) - ln(0.5::DOUBLE + exp(MIN(v) - MAX(v)))', 'floor')} FROM g GROUP BY seq_id",
    "frames_doubled": f"WITH {_F} SELECT seq_id, CAST(2 * frame AS INTEGER) AS frame, {_r('value')} FROM f UNION ALL SELECT seq_id, CAST(2 * frame + 1 AS INTEGER), round((value + COALESCE(lead(value) OVER ({_P}), value)) / 2, 6) + 0.0 FROM f",
    "frames_blended": f"""WITH {_F}, n AS (SELECT seq_id, MAX(frame) AS last FROM f GROUP BY 1), b AS (SELECT seq_id, frame + last - 3 AS frame, value, (frame + 1) / 5.0::DOUBLE AS t FROM f JOIN n USING (seq_id))
SELECT COALESCE(f.seq_id, b.seq_id) AS seq_id, CAST(COALESCE(f.frame, b.frame) AS INTEGER) AS frame, {_r('CASE WHEN f.value IS NULL THEN b.value WHEN b.value IS NULL THEN f.value ELSE f.value * (1 - t) + b.value * t END')} FROM f FULL JOIN b ON f.seq_id = b.seq_id AND f.frame = b.frame""",
    "contact_steps": f"""WITH {_F}, x AS (SELECT *, MAX(value) OVER w AS hi, MIN(value) OVER w AS lo FROM f WINDOW w AS (PARTITION BY seq_id)),
p AS (SELECT *, NOT EXISTS (SELECT 1 FROM f g WHERE g.seq_id = x.seq_id AND abs(g.frame - x.frame) <= 5 AND (g.value > x.value OR (g.value = x.value AND g.frame < x.frame))) AND value - lo > 0.02 * (hi - lo) AS up,
  NOT EXISTS (SELECT 1 FROM f g WHERE g.seq_id = x.seq_id AND abs(g.frame - x.frame) <= 5 AND (g.value < x.value OR (g.value = x.value AND g.frame < x.frame))) AND hi - value > 0.02 * (hi - lo) AS down FROM x)
SELECT seq_id, CAST(frame AS INTEGER) AS frame, CAST(COALESCE(last(CASE WHEN down THEN 0 WHEN up THEN 1 END IGNORE NULLS) OVER ({_P} ROWS UNBOUNDED PRECEDING), 1) AS INTEGER) AS step FROM p""",
    "vertex_error": f"WITH {PAIRS} SELECT seq_id, {_r('AVG(' + DIST.format(a='pred', b='truth') + ')', 'mpvpe')} FROM pairs GROUP BY seq_id",
    "loss_means": f"WITH {PAIRS}, d AS (SELECT abs(pred[1] - truth[1]) AS l1, pow(pred[1] - truth[1], 2) AS l2 FROM pairs) SELECT {_r('AVG(l1)', 'l1')}, {_r('AVG(l2)', 'l2')}, {_r('AVG(l1) + AVG(l2)', 'total')} FROM d",
    "batch_distances": f"WITH {VECTORS} SELECT a.vec_id // 8 AS batch, a.vec_id AS i, b.vec_id AS j, round({DIST.format(a='a.vec', b='b.vec')}, 5) AS d FROM vectors a JOIN vectors b ON a.vec_id // 8 = b.vec_id // 8",
    "prefix_variance": f"WITH {VECTORS}, x AS (SELECT vec_id, unnest(vec[1:CAST(vec_id % 60 + 2 AS INTEGER)]) AS v FROM vectors) SELECT vec_id, {_r('var_samp(v)', 'variance')} FROM x GROUP BY vec_id",
    "label_quota": f"""WITH {VECTORS}, a AS (SELECT label, vec, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || ':1'), vec_id) AS k FROM vectors), b AS (SELECT label, vec, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || ':2'), vec_id) AS k FROM vectors),
d AS (SELECT a.label, AVG({DIST.format(a='a.vec', b='b.vec')}) AS d FROM a JOIN b USING (label, k) WHERE k <= 10 GROUP BY a.label HAVING COUNT(*) = 10) SELECT {_r('AVG(d)', 'multimodality')}, COUNT(*) AS n_labels FROM d""",
    "corpus_rates": f"WITH a AS (SELECT COUNT(*) AS n_chunks, AVG(n_chars) AS m, CAST(SUM(n_chars) AS DOUBLE) * 8 / SUM(doc_id % 7 + 1) AS b FROM documents) SELECT n_chunks, {_r('m', 'mean_bytes')}, {_r('b', 'bits_per_second')}, {_r('b / 256000', 'of_wide')}, {_r('b / 64000', 'of_narrow')} FROM a",
    "mask_overlap": f"""WITH {VECTORS}, m AS (SELECT vec_id, vec, list_filter(generate_series(1, 32), lambda i: vec[i] > 0.05) AS a, list_filter(generate_series(1, 32), lambda i: vec[i + 32] > 0.05) AS b FROM vectors)
SELECT vec_id, {_r('COALESCE(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0)', 'iou')}, {_r('-0.5 * (1 + vec[2] - vec[1] * vec[1] - exp(vec[2]))', 'kl')},
{_r('-CASE WHEN vec_id % 2 = 1 THEN ln(vec[1] / 4 + 0.5::DOUBLE) ELSE ln(0.5::DOUBLE - vec[1] / 4) END', 'bce')} FROM m""",
    "renormalized": f"WITH {VECTORS}, o AS (SELECT {_STD} FROM vectors WHERE label < 5), n AS (SELECT {_STD} FROM vectors) SELECT vec_id, " + ", ".join(_r(f"(vec[{i}] * o.s{i} + o.m{i} - n.m{i}) / n.s{i}", f"v{i - 1}") for i in range(1, 5)) + " FROM vectors, o, n",
    "codes_replaced": f"""WITH {VECTORS}, r AS (SELECT vec, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42'), vec_id) - 1 AS k FROM vectors),
c AS (SELECT vec_id AS code, vec, vec_id % 2 = 1 AS dead, row_number() OVER (PARTITION BY vec_id % 2 ORDER BY vec_id) - 1 AS k FROM vectors WHERE vec_id < 6)
SELECT code, CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS i, round(unnest(CASE WHEN dead THEN r.vec[1:4] ELSE c.vec[1:4] END), 6) + 0.0 AS value, dead AS is_replaced FROM c JOIN r USING (k)""",
}
