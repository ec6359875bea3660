"""Codebook, feature and metric queries over `embeddings`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import codes as Q
from weftline.operators import features as V
from weftline.operators import metrics as M
from weftline.plans._tables import DIST, VECTORS, r6, table, vectors


def _book(v, k=16):
    return v.where(F.col("vec_id") < k).select(F.col("vec_id").alias("code"), "vec")


def _codes(spark, sf_dir):
    v = vectors(spark, sf_dir, 16)
    return v, Q.nearest_code(v, _book(v))


def nearest_code(spark, sf_dir):
    _, c = _codes(spark, sf_dir)
    return c.select("vec_id", "code", r6(F.col("d2")).alias("d2"))


def code_perplexity(spark, sf_dir):
    x = Q.perplexity(_codes(spark, sf_dir)[1])
    return x.select("n_codes", r6(F.col("perplexity")).alias("perplexity"))


def quant_error(spark, sf_dir):
    return _codes(spark, sf_dir)[1].agg(r6(F.avg(F.col("d2") / 16)).alias("mse"), r6(F.avg(F.col("d2") / 16) * 1.25).alias("with_commitment"))


def codebook_ema(spark, sf_dir):
    v, c = _codes(spark, sf_dir)
    book = _book(v).select("code", F.posexplode("vec").alias("i", "value")).withColumns({"count": F.lit(1.0), "total": F.col("value")})
    new = Q.ema_update(book, c.join(v, "vec_id").select("code", "vec"), 0.9, 1.5)
    return new.select("code", "i", r6(F.col("count")).alias("count"), r6(F.col("value")).alias("value"), "is_replaced")


def code_smoothing(spark, sf_dir):
    c = _codes(spark, sf_dir)[1].groupBy("code").agg(F.count("*").cast("double").alias("count"))
    return Q.smoothed_counts(c, 0.5).select("code", r6(F.col("smoothed")).alias("smoothed"))


def code_lookup(spark, sf_dir):
    v, c = _codes(spark, sf_dir)
    return Q.look_up(c, _book(v)).select("vec_id", "code", r6(F.get("code_vec", 0)).alias("first"), F.size("code_vec").cast("long").alias("width"))


def sign_codes(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", Q.bit_code(F.col("vec"), 16).alias("code"), r6(F.get(Q.sign_bits(F.col("vec")), 0)).alias("bit"))


def standardize(spark, sf_dir):
    v = vectors(spark, sf_dir, 8)
    s = V.channel_statistics(v)
    z = V.standardize(v, s)
    back = V.standardize(z, s, inverse=True)
    y = z.join(back.select("vec_id", F.col("vec").alias("b")), "vec_id")
    return y.select("vec_id", *[r6(F.get("vec", i)).alias(f"z{i}") for i in range(3)], r6(F.get("b", 1)).alias("back"))


def channel_stats(spark, sf_dir):
    s = V.channel_statistics(vectors(spark, sf_dir, 12))
    return s.select("i", *[r6(F.col(c)).alias(c) for c in ("mean", "std", "variance", "low", "high")], "n")


def constant_channels(spark, sf_dir):
    """Channels without variance: every third one is made constant here."""
    v = vectors(spark, sf_dir, 12).withColumn("vec", F.transform("vec", lambda x, i: F.when(i % 3 == 0, 1.5).otherwise(x)))
    return V.constant_channels(V.channel_statistics(v))


MASK = [1, 0, 0, 1, 1, 0, 1, 0]


def mask_select(spark, sf_dir):
    v = vectors(spark, sf_dir, 8)
    part = V.mask_select(F.col("vec"), MASK)
    back = V.mask_scatter(part, MASK)
    return v.select("vec_id", F.size(part).cast("long").alias("n"), r6(F.get(part, 1)).alias("second"), r6(F.get(back, 3)).alias("back"), r6(F.get(back, 2)).alias("zero"), V.has_signal(back).alias("has_signal"))


def zero_pad(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return v.select("vec_id", F.size(V.fit_width(F.col("vec"), 100)).cast("long").alias("wide"), r6(F.get(V.fit_width(F.col("vec"), 100), 80)).alias("pad"), F.size(V.fit_width(F.col("vec"), 16)).cast("long").alias("narrow"))


def resize_vectors(spark, sf_dir):
    x = V.resize_linear(F.col("vec"), 7)
    return vectors(spark, sf_dir, 16).select("vec_id", *[r6(F.get(x, i)).alias(f"x{i}") for i in (0, 3, 6)])


def box_overlap(spark, sf_dir):
    b = [F.get("vec", i) for i in range(8)]
    box = lambda o: [b[o], b[o + 1], b[o] + F.abs(b[o + 2]) + 0.1, b[o + 1] + F.abs(b[o + 3]) + 0.1]
    return vectors(spark, sf_dir, 8).select("vec_id", r6(V.box_iou(box(0), box(4))).alias("iou"), r6(V.huber(b[0] * 4)).alias("huber"))


def _pairs(spark, sf_dir):
    """Vectors with the one before: pred and truth, with a sequence of ten frames."""
    v = vectors(spark, sf_dir, 48)
    t = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("vec").alias("truth"))
    x = v.select("vec_id", F.col("vec").alias("pred")).join(t, "vec_id")
    return x.select(F.floor(F.col("vec_id") / 10).alias("seq_id"), (F.col("vec_id") % 10).alias("frame"), "pred", "truth")


PAIRS = f"{VECTORS}, pairs AS (SELECT a.vec_id // 10 AS seq_id, a.vec_id % 10 AS frame, a.vec[1:48] AS pred, b.vec[1:48] AS truth FROM vectors a JOIN vectors b ON a.vec_id = b.vec_id + 1)"


def mpjpe(spark, sf_dir):
    return M.joint_errors(_pairs(spark, sf_dir), 16).select("seq_id", "frame", r6(F.col("mpjpe")).alias("mpjpe"))


def mpjpe_mean(spark, sf_dir):
    return M.sequence_mean(M.joint_errors(_pairs(spark, sf_dir), 16), "mpjpe").select(r6(F.col("mpjpe")).alias("mpjpe"), "n_sequences")


def accel_error(spark, sf_dir):
    x = _pairs(spark, sf_dir).select("seq_id", "frame", F.get("pred", 0).alias("pred"), F.get("truth", 0).alias("truth"))
    return M.acceleration_error(x).select("seq_id", r6(F.col("accel")).alias("accel"))


def root_error(spark, sf_dir):
    x = _pairs(spark, sf_dir).select("seq_id", "frame", *[F.get(c, i).alias(f"{c[0]}{a}") for c in ("pred", "truth") for i, a in enumerate("xyz")])
    return M.root_errors(x).select(*[r6(F.col(c)).alias(c) for c in ("err_x", "err_y", "err_z", "err")])


def _vertices(spark, sf_dir):
    x = _pairs(spark, sf_dir).select("seq_id", "frame", F.posexplode(F.arrays_zip("pred", "truth")).alias("vertex", "v"))
    return x.select("seq_id", "frame", "vertex", F.col("v.pred").alias("pred"), F.col("v.truth").alias("truth"), F.abs(F.col("v.pred") - F.col("v.truth")).alias("err"))


_VERTS = "verts AS (SELECT seq_id, frame, CAST(unnest(generate_series(0, 47)) AS INTEGER) AS vertex, unnest(pred) AS pred, unnest(truth) AS truth FROM pairs)"


def lip_max(spark, sf_dir):
    return M.lip_error(_vertices(spark, sf_dir)).select(r6(F.col("lve")).alias("lve"), r6(F.col("mod")).alias("mod"), "n_frames")


def dynamics_dev(spark, sf_dir):
    return M.dynamics_deviation(_vertices(spark, sf_dir)).select("seq_id", r6(F.col("fdd")).alias("fdd"))


def l1_div(spark, sf_dir):
    x = _vertices(spark, sf_dir).select("seq_id", "frame", F.col("vertex").alias("dim"), F.col("pred").alias("value"))
    return M.l1_diversity(x).select(r6(F.col("l1_div")).alias("l1_div"))


def srgr(spark, sf_dir):
    x = _vertices(spark, sf_dir).withColumn("semantic", (F.col("frame") % 3) / 10)
    return M.gesture_recall(x).select(r6(F.col("srgr")).alias("srgr"), "n_frames")


def weighted_losses(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    x = M.weighted_means(d, ["quality", "toxic"], "n_chars")
    return x.select(r6(F.col("quality")).alias("quality"), r6(F.col("toxic")).alias("toxic"))


def diversity(spark, sf_dir):
    return M.diversity(vectors(spark, sf_dir), 100).select(r6(F.col("diversity")).alias("diversity"), "n_pairs")


def multimodality(spark, sf_dir):
    return M.diversity(vectors(spark, sf_dir), 10, group="label").select("label", r6(F.col("diversity")).alias("diversity"), "n_pairs")


def retrieval_topk(spark, sf_dir):
    v = vectors(spark, sf_dir)
    q = v.select(F.col("vec_id").alias("row"), F.slice("vec", 1, 32).alias("vec"))
    i = v.select(F.col("vec_id").alias("row"), F.slice("vec", 17, 32).alias("vec"))
    x = M.retrieval(q, i, 32)
    return x.select(*[r6(F.col(c)).alias(c) for c in ("matching", "top1", "top2", "top3")], "n")


def mean_cov(spark, sf_dir):
    return M.covariance(vectors(spark, sf_dir), 6).select("i", "j", r6(F.col("cov")).alias("cov"))


def frechet(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return M.frechet_distance(v.where("label < 5"), v.where("label >= 5")).select(r6(F.col("frechet")).alias("frechet"))


def kid(spark, sf_dir):
    """Subsets of 40 vectors a side, drawn from all of them."""
    v = vectors(spark, sf_dir)
    x = M.kernel_distance(*[M.subsets(v.where(side), 5, 40) for side in ("label < 5", "label >= 5")])
    return x.select("subset", r6(F.col("mmd2")).alias("mmd2"), r6(F.col("variance")).alias("variance"))


def procrustes_error(spark, sf_dir):
    return M.procrustes_errors(_pairs(spark, sf_dir)).select("seq_id", "frame", r6(F.col("pa_mpjpe")).alias("pa_mpjpe"))


def static_clips(spark, sf_dir):
    v = vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 4).alias("clip"), (F.col("vec_id") % 4).alias("frame"), F.slice("vec", 1, 3).alias("a"), F.slice("vec", 4, 3).alias("b"))
    return M.static_clips(v, 0.03)


def soft_entropy(spark, sf_dir):
    x = M.soft_entropy(vectors(spark, sf_dir, 16), 0.5)
    return x.select(r6(F.col("per_sample")).alias("per_sample"), r6(F.col("codebook")).alias("codebook"))


def spine_angles(spark, sf_dir):
    """Clips whose spine leans more than a limit, by the angle to the up axis."""
    v = vectors(spark, sf_dir, 3)
    x = M.leaning_clips(v.select(F.floor(F.col("vec_id") / 5).alias("clip"), M.up_angle(F.col("vec")).alias("angle")), 60, 50)
    return x.select("clip", r6(F.col("top")).alias("top"), r6(F.col("mean")).alias("mean"))


def neighbour_rank(spark, sf_dir):
    """Distance of each vector to the next one, ranked inside its label."""
    v = vectors(spark, sf_dir)
    n = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("next"))
    x = v.join(n, "vec_id").select("vec_id", "label", r6(M.distance(F.col("vec"), F.col("next"))).alias("d"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("d", "vec_id")))


QUERIES = {f.__name__: f for f in (nearest_code, code_perplexity, quant_error, codebook_ema, code_smoothing, code_lookup, sign_codes, standardize, channel_stats, constant_channels, mask_select, zero_pad, resize_vectors, box_overlap, mpjpe, mpjpe_mean, accel_error, root_error, lip_max, dynamics_dev, l1_div, srgr, weighted_losses, diversity, multimodality, retrieval_topk, mean_cov, frechet, kid, procrustes_error, static_clips, soft_entropy, spine_angles, neighbour_rank)}
_V16 = "v AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings)"
_D2 = "list_sum(list_transform(list_zip(v.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_CODES = f"{_V16}, pd AS (SELECT v.vec_id, b.vec_id AS code, {_D2} AS d2 FROM v, v b WHERE b.vec_id < 16), cd AS (SELECT vec_id, arg_min(code, struct_pack(d := d2, c := code)) AS code, MIN(d2) AS d2 FROM pd GROUP BY 1)"
_R = "round({x}, 6) + 0.0 AS {n}"
_x = lambda w: f"x AS (SELECT vec_id, CAST(unnest(generate_series(0, {w - 1})) AS INTEGER) AS i, unnest(vec[1:{w}]) AS x FROM vectors)"
_JOINTS = "list_sum(list_transform(generate_series(0, 15), lambda j: sqrt(" + " + ".join(f"pow((pred[j * 3 + {k}] - pred[{k}]) - (truth[j * 3 + {k}] - truth[{k}]), 2)" for k in (1, 2, 3)) + "))) / 16 * 1000"
_DOT = "list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: z[1] * z[2]))"
_SAMPLE = "SELECT {g} vec, row_number() OVER ({p} ORDER BY md5(CAST(vec_id AS VARCHAR) || ':{s}'), vec_id) AS k FROM vectors"
_SIG = "1 / (1 + exp(4 * x / sqrt(16) * 0.5))"
_H = "-(({p}) * ln(({p}) + 1e-8::DOUBLE) + (1 - ({p})) * ln(1 - ({p}) + 1e-8::DOUBLE))"
ORACLE = {
    "nearest_code": f"WITH {_CODES} SELECT vec_id, code, {_R.format(x='d2', n='d2')} FROM cd",
    "code_perplexity": f"WITH {_CODES}, h AS (SELECT COUNT(*) / SUM(COUNT(*)) OVER () AS p FROM cd GROUP BY code) SELECT COUNT(*) AS n_codes, {_R.format(x='exp(-SUM(p * ln(p + 1e-7::DOUBLE)))', n='perplexity')} FROM h",
    "quant_error": f"WITH {_CODES} SELECT {_R.format(x='AVG(d2 / 16)', n='mse')}, {_R.format(x='AVG(d2 / 16) * 1.25', n='with_commitment')} FROM cd",
    "codebook_ema": f"""WITH {_CODES}, e AS (SELECT vec_id, CAST(unnest(generate_series(0, 15)) AS INTEGER) AS i, unnest(vec) AS x FROM v), s AS (SELECT code, i, COUNT(*) AS n, SUM(x) AS t FROM cd JOIN e USING (vec_id) GROUP BY ALL),
u AS (SELECT b.vec_id AS code, b.i, b.x AS value, 0.9::DOUBLE + (1 - 0.9::DOUBLE) * COALESCE(n, 0) AS count, 0.9::DOUBLE * b.x + (1 - 0.9::DOUBLE) * COALESCE(t, 0) AS total FROM (SELECT * FROM e WHERE vec_id < 16) b LEFT JOIN s ON s.code = b.vec_id AND s.i = b.i)
SELECT code, i, {_R.format(x='count', n='count')}, round(CASE WHEN count >= 1.5 THEN total / count ELSE value END, 6) + 0.0 AS value, count < 1.5 AS is_replaced FROM u""",
    "code_smoothing": f"WITH {_CODES}, h AS (SELECT code, CAST(COUNT(*) AS DOUBLE) AS c FROM cd GROUP BY code) SELECT code, round((c + 0.5) / (SUM(c) OVER () + COUNT(*) OVER () * 0.5::DOUBLE) * SUM(c) OVER (), 6) + 0.0 AS smoothed FROM h",
    "code_lookup": f"WITH {_CODES} SELECT cd.vec_id, cd.code, round(v.vec[1], 6) + 0.0 AS first, len(v.vec) AS width FROM cd JOIN v ON v.vec_id = cd.code",
    "sign_codes": f"WITH {VECTORS} SELECT vec_id, CAST(list_sum(list_transform(vec[1:16], lambda x, i: CASE WHEN x > 0 THEN 1 << (16 - i)::INTEGER ELSE 0 END)) AS BIGINT) AS code, CASE WHEN vec[1] > 0 THEN 0.125::DOUBLE ELSE -0.125::DOUBLE END AS bit FROM vectors",
    "standardize": f"WITH {VECTORS}, s AS (SELECT " + ", ".join(f"AVG(vec[{i}]) AS m{i}, stddev_pop(vec[{i}]) AS s{i}" for i in (1, 2, 3)) + " FROM vectors) SELECT vec_id, " + ", ".join(f"round((vec[{i}] - m{i}) / s{i}, 6) + 0.0 AS z{i - 1}" for i in (1, 2, 3)) + ", round(vec[2], 6) + 0.0 AS back FROM vectors, s",
    "channel_stats": f"WITH {VECTORS}, {_x(12)} SELECT i, round(AVG(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) + 0.0 AS std, round(var_samp(x), 6) + 0.0 AS variance, round(MIN(x), 6) + 0.0 AS low, round(MAX(x), 6) + 0.0 AS high, COUNT(*) AS n FROM x GROUP BY i",
    "constant_channels": "SELECT CAST(unnest([0, 3, 6, 9]) AS INTEGER) AS i",
    "mask_select": f"WITH {VECTORS} SELECT vec_id, CAST(4 AS BIGINT) AS n, round(vec[4], 6) + 0.0 AS second, round(vec[4], 6) + 0.0 AS back, 0.0::DOUBLE AS zero, vec[1] <> 0 OR vec[4] <> 0 OR vec[5] <> 0 OR vec[7] <> 0 AS has_signal FROM vectors",
    "zero_pad": f"WITH {VECTORS} SELECT vec_id, CAST(100 AS BIGINT) AS wide, 0.0::DOUBLE AS pad, CAST(16 AS BIGINT) AS narrow FROM vectors",
    "resize_vectors": f"WITH {VECTORS} SELECT vec_id, round(vec[1], 6) + 0.0 AS x0, round(vec[8] * 0.5 + vec[9] * 0.5, 6) + 0.0 AS x3, round(vec[16], 6) + 0.0 AS x6 FROM vectors",
    "box_overlap": f"""WITH {VECTORS}, b AS (SELECT vec_id, vec[1] AS ax, vec[2] AS ay, vec[1] + abs(vec[3]) + 0.1::DOUBLE AS aX1, vec[2] + abs(vec[4]) + 0.1::DOUBLE AS aY1, vec[5] AS bx, vec[6] AS b_y, vec[5] + abs(vec[7]) + 0.1::DOUBLE AS bX1, vec[6] + abs(vec[8]) + 0.1::DOUBLE AS bY1, abs(vec[1] * 4) AS h FROM vectors),
i AS (SELECT *, greatest(least(aX1, bX1) - greatest(ax, bx), 0) * greatest(least(aY1, bY1) - greatest(ay, b_y), 0) AS inter FROM b)
SELECT vec_id, round(inter / ((aX1 - ax) * (aY1 - ay) + (bX1 - bx) * (bY1 - b_y) - inter), 6) + 0.0 AS iou, round(CASE WHEN h < 1 THEN 0.5 * h * h ELSE h - 0.5 END, 6) + 0.0 AS huber FROM i""",
    "mpjpe": f"WITH {PAIRS} SELECT seq_id, frame, {_R.format(x=_JOINTS, n='mpjpe')} FROM pairs",
    "mpjpe_mean": f"WITH {PAIRS}, f AS (SELECT seq_id, {_JOINTS} AS m FROM pairs), s AS (SELECT AVG(m) AS m FROM f GROUP BY seq_id) SELECT {_R.format(x='AVG(m)', n='mpjpe')}, COUNT(*) AS n_sequences FROM s",
    "accel_error": f"""WITH {PAIRS}, x AS (SELECT seq_id, (lead(pred[1]) OVER w - 2 * pred[1] + lag(pred[1]) OVER w) - (lead(truth[1]) OVER w - 2 * truth[1] + lag(truth[1]) OVER w) AS d FROM pairs WINDOW w AS (PARTITION BY seq_id ORDER BY frame))
SELECT seq_id, {_R.format(x='AVG(abs(d))', n='accel')} FROM x WHERE d IS NOT NULL GROUP BY 1""",
    "root_error": f"""WITH {PAIRS}, d AS (SELECT seq_id, pred[1] - truth[1] AS x, pred[2] - truth[2] AS y, pred[3] - truth[3] AS z FROM pairs), s AS (SELECT AVG(abs(x)) AS x, AVG(abs(y)) AS y, AVG(abs(z)) AS z, AVG(sqrt(x * x + y * y + z * z)) AS e FROM d GROUP BY seq_id)
SELECT round(AVG(x), 6) + 0.0 AS err_x, round(AVG(y), 6) + 0.0 AS err_y, round(AVG(z), 6) + 0.0 AS err_z, round(AVG(e), 6) + 0.0 AS err FROM s""",
    "lip_max": f"WITH {PAIRS}, {_VERTS}, f AS (SELECT MAX(abs(pred - truth)) AS m, AVG(abs(pred - truth)) AS a FROM verts GROUP BY seq_id, frame) SELECT round(AVG(m), 6) + 0.0 AS lve, round(AVG(a), 6) + 0.0 AS mod, COUNT(*) AS n_frames FROM f",
    "dynamics_dev": f"WITH {PAIRS}, {_VERTS}, d AS (SELECT seq_id, stddev_pop(truth) - stddev_pop(pred) AS d FROM verts GROUP BY seq_id, vertex) SELECT seq_id, round(AVG(d), 6) + 0.0 AS fdd FROM d GROUP BY 1",
    "l1_div": f"WITH {PAIRS}, {_VERTS}, d AS (SELECT seq_id, frame, abs(pred - AVG(pred) OVER (PARTITION BY seq_id, vertex)) AS d FROM verts), f AS (SELECT SUM(d) AS d FROM d GROUP BY seq_id, frame) SELECT round(AVG(d), 6) + 0.0 AS l1_div FROM f",
    "srgr": f"WITH {PAIRS}, {_VERTS} SELECT round(SUM(CASE WHEN abs(pred - truth) < 0.1 THEN 1 ELSE 0 END * ((frame % 3) / 10.0::DOUBLE) / 0.165::DOUBLE) / COUNT(*), 6) + 0.0 AS srgr, COUNT(*) AS n_frames FROM verts",
    "weighted_losses": "SELECT round(SUM(quality * n_chars) / SUM(n_chars), 6) + 0.0 AS quality, round(SUM(toxic * n_chars) / SUM(n_chars), 6) + 0.0 AS toxic FROM documents JOIN labels USING (doc_id)",
    "diversity": f"WITH {VECTORS}, a AS ({_SAMPLE.format(g='', p='', s=1)}), b AS ({_SAMPLE.format(g='', p='', s=2)}) SELECT round(AVG({DIST.format(a='a.vec', b='b.vec')}), 6) + 0.0 AS diversity, COUNT(*) AS n_pairs FROM a JOIN b USING (k) WHERE k <= 100",
    "multimodality": f"WITH {VECTORS}, a AS ({_SAMPLE.format(g='label,', p='PARTITION BY label', s=1)}), b AS ({_SAMPLE.format(g='label,', p='PARTITION BY label', s=2)}) SELECT label, round(AVG({DIST.format(a='a.vec', b='b.vec')}), 6) + 0.0 AS diversity, COUNT(*) AS n_pairs FROM a JOIN b USING (label, k) WHERE k <= 10 GROUP BY label",
    "retrieval_topk": f"""WITH {VECTORS}, d AS (SELECT a.vec_id AS q, b.vec_id AS i, {DIST.format(a='a.vec[1:32]', b='b.vec[17:48]')} AS d FROM vectors a JOIN vectors b ON a.vec_id // 32 = b.vec_id // 32),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, i) AS k FROM d) SELECT round(AVG(d), 6) + 0.0 AS matching, """ + ", ".join(f"round(AVG(CASE WHEN k <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS top{k}" for k in (1, 2, 3)) + ", COUNT(*) AS n FROM r WHERE q = i",
    "mean_cov": f"WITH {VECTORS}, {_x(6)} SELECT a.i, b.i AS j, round(covar_samp(a.x, b.x), 6) + 0.0 AS cov FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i",
    "kid": f"""WITH {VECTORS}, d AS (SELECT vec_id, vec, label < 5 AS side, unnest(generate_series(0, 4)) AS subset FROM vectors),
r AS (SELECT *, row_number() OVER (PARTITION BY side, subset ORDER BY md5(CAST(vec_id AS VARCHAR) || ':' || (42 + subset)), vec_id) AS n FROM d), s AS (SELECT * FROM r WHERE n <= 40),
k AS (SELECT a.subset, a.side, b.side AS other, a.vec_id AS i, pow({_DOT} / 64 + 1, 3) AS k FROM s a JOIN s b ON a.subset = b.subset AND (a.side <> b.side OR a.vec_id <> b.vec_id)),
p AS (SELECT subset, side, i, SUM(k) FILTER (WHERE side = other) AS t, SUM(k * k) FILTER (WHERE side = other) AS t2, SUM(k) FILTER (WHERE side <> other) AS c, SUM(k * k) FILTER (WHERE side <> other) AS c2 FROM k GROUP BY ALL),
g AS (SELECT subset, 40.0::DOUBLE AS m, SUM(t) AS xy, SUM(t2) AS xy2, SUM(t * t) AS xys, SUM(c) / 2 AS c, SUM(c2) / 2 AS c2, SUM(c * c) AS cs, SUM(t * c) AS dots, SUM(t) FILTER (WHERE side) AS x, SUM(t) FILTER (WHERE NOT side) AS y FROM p GROUP BY subset),
z AS (SELECT *, (x * x + y * y) / pow(m * (m - 1), 2) AS alone, 2 * c * c / pow(m, 4) AS cc, dots / (m * m * (m - 1)) AS crossed, xy * c / (pow(m, 3) * (m - 1)) AS mixed FROM g)
SELECT CAST(subset AS INTEGER) AS subset, round(xy / (m * (m - 1)) - 2 * c / (m * m), 6) + 0.0 AS mmd2,
round(4 * (m - 2) / (m * (m - 1)) * ((xys - xy2) / (m * (m - 1) * (m - 2)) - alone + (cs - 2 * c2) / (m * m * (m - 1)) - cc - 2 * crossed + 2 * mixed) + 2 / (m * (m - 1)) * (xy2 / (m * (m - 1)) - alone + 2 * c2 / (m * m) - cc - 4 * crossed + 4 * mixed), 6) + 0.0 AS variance FROM z""",
    "static_clips": f"WITH {VECTORS}, v AS (SELECT vec_id // 4 AS clip, " + ", ".join(f"var_pop(vec[{i}]) AS v{i}" for i in range(1, 7)) + " FROM vectors GROUP BY 1) SELECT clip FROM v WHERE v1 + v2 + v3 < 0.03 AND v4 + v5 + v6 < 0.03",
    "soft_entropy": f"WITH {VECTORS}, {_x(16)}, p AS (SELECT vec_id, i, {_SIG} AS p FROM x), a AS (SELECT SUM({_H.format(p='p')}) AS s FROM p GROUP BY vec_id), b AS (SELECT AVG(p) AS p FROM p GROUP BY i) SELECT (SELECT round(AVG(s), 6) + 0.0 FROM a) AS per_sample, (SELECT round(SUM({_H.format(p='p')}), 6) + 0.0 FROM b) AS codebook",
    "spine_angles": f"""WITH {VECTORS}, a AS (SELECT vec_id // 5 AS clip, degrees(acos(abs(vec[2]) / sqrt(vec[1] * vec[1] + vec[2] * vec[2] + vec[3] * vec[3]))) AS angle FROM vectors)
SELECT clip, round(MAX(angle), 6) + 0.0 AS top, round(AVG(angle), 6) + 0.0 AS mean FROM a GROUP BY clip HAVING MAX(angle) > 60 OR AVG(angle) > 50""",
    "neighbour_rank": f"WITH {VECTORS}, d AS (SELECT a.vec_id, a.label, round({DIST.format(a='a.vec', b='b.vec')}, 6) + 0.0 AS d FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1) SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS INTEGER) AS rank FROM d",
}
