"""Composed loaders over stand-ins: users' events as motion, tokens and words."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import features, stages
from weftline.plans._tables import FRAMES, VECTORS, frames, r6, table, vectors
from weftline.plans.tokens import STREAMS, _joined, _streams
from weftline.sources import corpora


def _motion(spark, sf_dir):
    f = frames(spark, sf_dir)
    value = F.col("value")
    return f.select(F.concat((F.col("seq_id") % 10).cast("string"), F.lit("_"), F.col("seq_id").cast("string")).alias("seq_id"), F.col("frame"), F.array(value, value * 2, F.lit(1.0)).alias("poses"), F.col("event_id").alias("trans"))


def _rules(spark, sf_dir):
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    kind = F.when(F.col("user_id") % 5 == 0, "test").when(F.col("user_id") % 7 == 0, "additional").otherwise("train")
    return u.select(F.concat((F.col("user_id") % 10).cast("string"), F.lit("_"), F.col("user_id").cast("string")).alias("id"), kind.alias("type"))


def _digest(clips, column):
    return clips.select("seq_id", "clip", "start", "stop", r6(F.aggregate(F.transform("poses", lambda p: F.get(p, 0)), F.lit(0.0), lambda s, x: s + x)).alias("total"), F.size(F.get(F.col("poses"), 0)).cast("long").alias("width"), _joined(F.col(column), "ids"))


def load_train(spark, sf_dir):
    x = corpora.motion_clips(_motion(spark, sf_dir), _rules(spark, sf_dir), "train", [1, 3, 4], ["poses", "trans"], 5, 20, 7, additional=True)
    return _digest(x, "trans")


def load_test(spark, sf_dir):
    """Whole sequences of the test split, at half the rate, one channel of three."""
    x = corpora.motion_clips(_motion(spark, sf_dir), _rules(spark, sf_dir), "test", [0, 5], ["poses", "trans"], 5, 20, 7, keep_every=2, mask=[0, 1, 0])
    return _digest(x, "trans")


def load_normalised(spark, sf_dir):
    m = _motion(spark, sf_dir)
    stats = features.channel_statistics(m.select(F.col("poses").alias("vec")))
    x = corpora.motion_clips(m, _rules(spark, sf_dir), "train", [2], ["poses", "trans"], 5, 20, 20, stats=stats)
    total = lambda k: F.aggregate(F.transform("poses", lambda p: F.get(p, k)), F.lit(0.0), lambda s, v: s + v)
    return x.select("seq_id", "clip", *[F.round(total(k), 5).alias(f"s{k}") for k in range(2)])


def load_segments(spark, sf_dir):
    x = corpora.segment_sequences(_motion(spark, sf_dir), ["poses", "trans"], 50, 25, 30)
    return _digest(x, "trans")


def load_pairs(spark, sf_dir):
    """Users 2k and 2k + 1 as the speakers of a conversation; every fifth has a third one."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    third = u.where("user_id % 10 = 0").select((F.col("user_id") / 2).cast("long").alias("conv_id"), F.lit(2).cast("long").alias("k"), F.col("user_id").alias("file"))
    structure = u.select(F.floor(F.col("user_id") / 2).alias("conv_id"), (F.col("user_id") % 2).alias("k"), F.col("user_id").alias("file")).union(third.withColumn("file", F.lit(1).cast("long")))
    f = frames(spark, sf_dir).select("seq_id", "frame", F.col("event_id").alias("coeff"))
    x = corpora.speaker_pairs(structure, f, ["coeff"])
    return x.select("conv_id", F.col("n_frames").cast("long").alias("n_frames"), "file_0", "file_1", _joined(F.col("coeff_0"), "c0"), _joined(F.col("coeff_1"), "c1"))


def _utterances(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    key = [F.lit("t").alias("trainset"), (F.col("user_id") % 6).alias("speaker_id"), F.floor(F.col("user_id") / 6).alias("chapter_id"), F.col("event_type").alias("utterance_id"), (F.col("event_id") % 2).alias("part_id")]
    return e.select(*key, "event_id", "value")


def load_utterances(spark, sf_dir):
    x = _utterances(spark, sf_dir)
    tokens = x.groupBy(*corpora.UTTERANCE_KEY).agg(F.array_sort(F.collect_list((F.col("event_id") % 512).cast("int"))).alias("tokens"))
    texts = x.where("value > 20").groupBy(*corpora.UTTERANCE_KEY).agg(F.concat(F.lit("said "), F.count("*").cast("string")).alias("text"))
    tasks = spark.createDataFrame([("asr", "transcribe"), ("tts", "speak")], "task string, prompt string")
    return corpora.utterance_samples(tokens, texts, tasks, 3, 12).select("speaker_id", "chapter_id", "utterance_id", "part_id", "text", "task", "prompt", _joined(F.col("tokens"), "tokens"))


def load_transcribed(spark, sf_dir):
    """Token chunks of users with the events' types as words of half a second."""
    tokens = _streams(spark, sf_dir).select(F.col("user_id").alias("seq_id"), F.col("a").alias("tokens"))
    words = frames(spark, sf_dir).select("seq_id", F.col("frame").alias("idx"), F.col("event_type").alias("mark"), (F.col("frame") * 0.5).alias("start"), (F.col("frame") * 0.5 + 0.5).alias("stop"))
    x = corpora.transcribed_tokens(tokens, words, 4.0, 16, 8)
    return x.select("seq_id", "clip", r6(F.col("start")).alias("start"), _joined(F.col("tokens"), "tokens"), F.md5("words").alias("words_md5"))


def load_captioned(spark, sf_dir):
    s = _streams(spark, sf_dir).select(F.col("user_id").alias("seq_id"), F.col("a").alias("tokens"))
    captions = frames(spark, sf_dir).where("frame < 3").select("seq_id", F.col("frame").alias("line"), F.concat(F.lit("does "), "event_type").alias("caption"), (F.col("frame") * 1.5).alias("start"), (F.col("frame") * 4.0).alias("stop"))
    x = corpora.captioned_tokens(s, captions, 20.0, 5, 60, 4)
    return x.select("seq_id", "line", "caption", _joined(F.col("tokens"), "tokens"))


def load_dialogue(spark, sf_dir):
    """Conversations of users 2k and 2k + 1 with both streams, in chunks of training; tagged."""
    s = _streams(spark, sf_dir).select(F.floor(F.col("user_id") / 2).alias("conv_id"), (F.col("user_id") % 2).alias("speaker"), F.col("a").alias("audio"), F.col("b").alias("face"))
    x = corpora.with_tags(corpora.paired_tokens(s.where("conv_id % 9 <> 0 or speaker = 0"), 12), dataset="users", fps=25)
    return x.select("conv_id", "speaker", "clip", _joined(F.col("audio"), "audio"), _joined(F.col("face"), "face"), "dataset", "fps")


def load_listed(spark, sf_dir):
    """Clips of the sequences that an id list names, as a reader gives it."""
    clips_ = frames(spark, sf_dir).select("seq_id", F.floor(F.col("frame") / 20).alias("clip"), "event_id").groupBy("seq_id", "clip").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    ids = spark.range(0, 400, 3).select(F.concat(F.lit("M_"), F.col("id").cast("string")).alias("id"))
    return corpora.listed_clips(clips_, ids, "M_", ["ids"]).select("seq_id", "clip", F.size("ids").cast("long").alias("n"), F.get("ids", 0).alias("first"))


def staged(spark, sf_dir):
    """Vectors standardised and masked by a fitted chain, and back."""
    v = vectors(spark, sf_dir, 6)
    chain = stages.Chain((stages.Standardized(), stages.Masked((1, 0, 1, 1, 0, 0)))).fit(v)
    there = chain.transform(v)
    back = chain.inverse(there)
    return there.select("vec_id", *[r6(F.get("vec", i)).alias(f"z{i}") for i in range(3)]).join(back.select("vec_id", *[r6(F.get("vec", i)).alias(f"b{i}") for i in range(6)]), "vec_id")


QUERIES = {f.__name__: f for f in (load_train, load_test, load_normalised, load_segments, load_pairs, load_utterances, load_transcribed, load_captioned, load_dialogue, load_listed, staged)}
_M = f"{FRAMES}, m AS (SELECT (seq_id % 10) || '_' || seq_id AS seq_id, seq_id AS u, frame, value, event_id FROM frames)"
_KIND = "CASE WHEN u % 5 = 0 THEN 'test' WHEN u % 7 = 0 THEN 'additional' ELSE 'train' END"
_CLIPS = "n AS (SELECT seq_id, CASE WHEN COUNT(*) < 5 THEN 5 ELSE COUNT(*) // 5 * 5 END AS n FROM m {where} GROUP BY 1), c AS (SELECT seq_id, unnest(generate_series(0, CAST(floor((n - 20) / {stride}) AS BIGINT))) AS clip FROM n WHERE n >= 20)"
_SUM = "CAST(c.clip AS INTEGER) AS clip, CAST(c.clip * {stride} AS INTEGER) AS start, CAST(c.clip * {stride} + {length} AS INTEGER) AS stop, round(SUM(value), 6) + 0.0 AS total, {width} AS width, string_agg(event_id, ',' ORDER BY frame) AS ids"
_STR = "COALESCE(array_to_string({x}, ','), '')"
ORACLE = {
    "load_train": f"""WITH {_M}, {_CLIPS.format(where=f"WHERE ({_KIND} = 'train' AND u % 10 IN (1, 3, 4)) OR {_KIND} = 'additional'", stride=7)}
SELECT c.seq_id, {_SUM.format(stride=7, length=20, width=3)} FROM c JOIN m ON m.seq_id = c.seq_id AND frame >= c.clip * 7 AND frame < c.clip * 7 + 20 GROUP BY c.seq_id, c.clip""",
    "load_test": f"""WITH {_M}, h AS (SELECT seq_id, u, frame // 2 AS frame, value * 2 AS value, event_id FROM m WHERE frame % 2 = 0 AND {_KIND} = 'test' AND u % 10 IN (0, 5)), n AS (SELECT seq_id, CASE WHEN COUNT(*) < 5 THEN 5 ELSE COUNT(*) // 5 * 5 END AS n FROM h GROUP BY 1)
SELECT seq_id, 0 AS clip, 0 AS start, CAST(n AS INTEGER) AS stop, round(SUM(value), 6) + 0.0 AS total, 1 AS width, string_agg(event_id, ',' ORDER BY frame) AS ids FROM h JOIN n USING (seq_id) WHERE frame < n GROUP BY seq_id, n""",
    "load_normalised": f"""WITH {_M}, {_CLIPS.format(where=f"WHERE {_KIND} = 'train' AND u % 10 = 2", stride=20)}, s AS (SELECT AVG(value) AS a, stddev_pop(value) AS d FROM m)
SELECT c.seq_id, CAST(c.clip AS INTEGER) AS clip, round(SUM((value - a) / d), 5) AS s0, round(SUM((value * 2 - 2 * a) / (2 * d)), 5) AS s1 FROM c JOIN m ON m.seq_id = c.seq_id AND frame >= c.clip * 20 AND frame < c.clip * 20 + 20, s GROUP BY c.seq_id, c.clip""",
    "load_segments": f"""WITH {_M}, n AS (SELECT seq_id, COUNT(*) AS n FROM m GROUP BY 1 HAVING COUNT(*) > 30), c AS (SELECT seq_id, n, unnest(generate_series(0, CASE WHEN n > 50 THEN (n - 50) // 25 ELSE 0 END)) AS clip FROM n)
SELECT c.seq_id, CAST(c.clip AS INTEGER) AS clip, CAST(c.clip * 25 AS INTEGER) AS start, CASE WHEN n > 50 THEN c.clip * 25 + 50 ELSE n END AS stop, round(SUM(value), 6) + 0.0 AS total, 3 AS width, string_agg(event_id, ',' ORDER BY frame) AS ids
FROM c JOIN m ON m.seq_id = c.seq_id AND frame >= c.clip * 25 AND frame < CASE WHEN n > 50 THEN c.clip * 25 + 50 ELSE n END GROUP BY c.seq_id, c.clip, n""",
    "load_pairs": f"""WITH {FRAMES}, n AS (SELECT seq_id, list(event_id ORDER BY frame) AS c FROM frames GROUP BY 1), p AS (SELECT a.seq_id // 2 AS conv_id, a.seq_id AS file_0, b.seq_id AS file_1, a.c AS x, b.c AS y, least(len(a.c), len(b.c)) AS n FROM n a JOIN n b ON b.seq_id = a.seq_id + 1 AND a.seq_id % 2 = 0 AND (a.seq_id % 10 <> 0 OR NOT EXISTS (SELECT 1 FROM n WHERE seq_id = 1)))
SELECT conv_id, n AS n_frames, file_0, file_1, array_to_string(x[1:n], ',') AS c0, array_to_string(y[1:n], ',') AS c1 FROM p""",
    "load_utterances": f"""WITH x AS (SELECT user_id % 6 AS speaker_id, user_id // 6 AS chapter_id, event_type AS utterance_id, event_id % 2 AS part_id, event_id % 512 AS t, value FROM events),
g AS (SELECT speaker_id, chapter_id, utterance_id, part_id, list(t ORDER BY t) AS tokens, COUNT(*) FILTER (WHERE value > 20) AS said FROM x GROUP BY ALL)
SELECT speaker_id, chapter_id, utterance_id, part_id, 'said ' || said AS text, task, prompt, array_to_string(tokens, ',') AS tokens FROM g, (VALUES ('asr', 'transcribe'), ('tts', 'speak')) v(task, prompt) WHERE said > 0 AND len(tokens) BETWEEN 3 AND 12""",
    "load_transcribed": f"""WITH {STREAMS}, c AS (SELECT user_id, a, unnest(generate_series(0, (len(a) - 16) // 8)) AS clip FROM s WHERE len(a) >= 16),
w AS (SELECT user_id, frame, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, event_type FROM (SELECT user_id, ts, event_id, event_type, 0 AS frame FROM events))
SELECT c.user_id AS seq_id, CAST(clip AS INTEGER) AS clip, round(clip * 2.0::DOUBLE, 6) + 0.0 AS start, array_to_string(any_value(a)[clip * 8 + 1 : clip * 8 + 16], ',') AS tokens, md5(COALESCE(string_agg(event_type, ' ' ORDER BY k), '')) AS words_md5
FROM c LEFT JOIN w ON w.user_id = c.user_id AND k * 0.5 >= clip * 2.0 AND k * 0.5 + 0.5 <= clip * 2.0 + 4.0 GROUP BY c.user_id, clip""",
    "load_captioned": f"""WITH {STREAMS}, {FRAMES}, x AS (SELECT seq_id, CAST(frame AS INTEGER) AS line, 'does ' || event_type AS caption, CASE WHEN frame = 0 THEN a ELSE a[CAST(floor(frame * 7.5) AS BIGINT) + 1 : CAST(floor(frame * 20.0) AS BIGINT)] END AS t FROM frames JOIN s ON s.user_id = seq_id WHERE frame < 3)
SELECT seq_id, line, caption, array_to_string(t, ',') AS tokens FROM x WHERE len(t) BETWEEN 5 AND 60""",
    "load_dialogue": f"""WITH {STREAMS}, x AS (SELECT user_id // 2 AS conv_id, user_id % 2 AS speaker, a, b FROM s WHERE len(a) > 0 AND len(b) > 0 AND ((user_id // 2) % 9 <> 0 OR user_id % 2 = 0)),
k AS (SELECT *, COUNT(*) OVER (PARTITION BY conv_id) AS sides, least(len(a), 2 * len(b)) AS n FROM x), c AS (SELECT *, unnest(generate_series(0, (n - 12) // 6)) AS clip FROM k WHERE sides = 2 AND n >= 12)
SELECT conv_id, speaker, CAST(clip AS INTEGER) AS clip, array_to_string(a[clip * 6 + 1 : clip * 6 + 12], ',') AS audio, array_to_string(b[clip * 3 + 1 : clip * 3 + 6], ',') AS face, 'users' AS dataset, 25 AS fps FROM c""",
    "load_listed": f"WITH {FRAMES} SELECT seq_id, frame // 20 AS clip, COUNT(*) AS n, MIN(event_id) AS first FROM frames WHERE seq_id % 3 = 0 AND seq_id < 400 GROUP BY ALL",
    "staged": f"""WITH {VECTORS}, s AS (SELECT {', '.join(f'AVG(vec[{i}]) AS m{i}, stddev_pop(vec[{i}]) AS d{i}' for i in range(1, 7))} FROM vectors)
SELECT vec_id, {', '.join(f'round((vec[{i}] - m{i}) / d{i}, 6) + 0.0 AS z{k}' for k, i in enumerate((1, 3, 4)))}, {', '.join(f'round({f"vec[{i}]" if i in (1, 3, 4) else f"m{i}"}, 6) + 0.0 AS b{i - 1}' for i in range(1, 7))} FROM vectors, s""",
}
