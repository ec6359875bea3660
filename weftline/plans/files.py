"""Readers and writers on files that the queries write first, in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators.corpus import hash_order
from weftline.operators.shared import stored
from weftline.plans._tables import FRAMES, VECTORS, frames, r6, table
from weftline.sources import arrays, bvh, readers, writers


def _folder(spark) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='spark-files-')}/files-{uuid.uuid4().hex}"


def _lines(spark, rows, column="value") -> str:
    path = _folder(spark)
    rows.select(F.col(column).alias("value")).write.text(path)
    return path


def _files(spark, rows, key, value) -> str:
    """One text file a key, in a folder named by it."""
    path = _folder(spark)
    rows.select(F.col(key).alias("key"), F.col(value).alias("value")).repartition("key").write.partitionBy("key").text(path)
    return f"{path}/*"


def _key():
    return F.regexp_extract("file", r"key=(\d+)", 1).cast("long").alias("seq_id")


def _whole(f, line, *head):
    """One text a user: head lines, then a line a frame, in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame", line.alias("line")))), lambda x: x["line"]), "\n")
    return f.groupBy("seq_id").agg(F.concat(F.lit("".join(f"{h}\n" for h in head)), body).alias("value"))


def read_jsonl(spark, sf_dir):
    path = _folder(spark)
    table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("conv_id"), "text").write.json(path)
    return readers.jsonl_texts(spark, path, "conv").select("sample_id", "conv_id", F.md5("text").alias("text_md5"))


def read_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.concat(F.lit("  s"), F.col("doc_id").cast("string"), F.lit(" "))).alias("value"))
    return readers.id_list(spark, _lines(spark, d))


def read_rules(spark, sf_dir):
    path = _folder(spark)
    table(spark, sf_dir, "documents").select(F.concat_ws("_", "doc_id", "source").alias("id"), F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("type")).write.option("header", True).csv(path)
    return readers.split_rules(spark, path)


def read_word_vectors(spark, sf_dir):
    """Lines of a word and four numbers; every fifth line lacks one and is skipped."""
    # times a float: a float times a whole number is a double in Spark, which rounds the other way where the float's product is a half
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: F.round(x * F.lit(1000).cast("float")).cast("long").cast("string")).alias("n"))
    line = F.concat(F.lit("w"), F.col("vec_id").cast("string"), F.lit(" "), F.array_join(F.when(F.col("vec_id") % 5 == 0, F.slice("n", 1, 3)).otherwise(F.col("n")), " "))
    return readers.word_vectors(spark, _lines(spark, v.select(line.alias("value"))), 4).select("word", *[F.get("vec", i).cast("long").alias(f"v{i}") for i in range(4)])


def read_semantic(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat_ws("\t", "event_id", F.col("user_id") / 2, F.col("user_id") / 2 + 1.5, F.lit(1.5), F.col("user_id") % 7, "event_type").alias("value"))
    return readers.semantic_scores(spark, _lines(spark, e))


def read_intervals(spark, sf_dir):
    f = frames(spark, sf_dir)
    line = F.concat(F.lit("intervals [1]:\n  xmin = "), (F.col("frame") / 2).cast("string"), F.lit(" \n  xmax = "), (F.col("frame") / 2 + 0.5).cast("string"), F.lit(' \n  text = "say ""'), "event_type", F.lit('""" '))
    path = _files(spark, _whole(f, line, 'File type = "ooTextFile"', "item [1]:"), "seq_id", "value")
    return readers.word_intervals(spark, path).select(_key(), "idx", "start", "stop", "mark")


def read_faces(spark, sf_dir):
    f = frames(spark, sf_dir).groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("frame", "event_id"))).alias("x"))
    text = F.to_json(F.struct(F.transform("x", lambda r: F.struct(F.array(r["event_id"], r["frame"]).alias("weights"), (r["frame"] / 25).alias("time"))).alias("frames")))
    path = _files(spark, f.select("seq_id", text.alias("value")), "seq_id", "value")
    return readers.facial_frames(spark, path).select(_key(), "frame", *[F.get("weights", i).cast("long").alias(f"w{i}") for i in range(2)])


HEAD = ("HIERARCHY", "ROOT Hips", "{", "  CHANNELS 2 Xposition Yposition", "  JOINT Foot", "  {", "    CHANNELS 1 Zrotation", "  }", "}", "MOTION", "Frames: 0", "Frame Time: 0.04")


def _motion(spark, sf_dir) -> str:
    line = F.concat_ws(" ", F.col("event_id").cast("string"), F.col("frame").cast("string"), (F.col("frame") / 4).cast("string"))
    return _files(spark, _whole(frames(spark, sf_dir), line, *HEAD), "seq_id", "value")


def read_motion(spark, sf_dir):
    x = readers.bvh_motion(spark, _motion(spark, sf_dir))
    return x.select(_key(), "frame", r6(F.col("t")).alias("t"), "channel", r6(F.col("value")).alias("value"))


def read_raw_motion(spark, sf_dir):
    """Every fourth line of the same files, without twelve lines of head."""
    x = readers.raw_motion_lines(spark, _motion(spark, sf_dir), len(HEAD), 4)
    return x.select(_key(), "line", F.get("vec", 0).cast("long").alias("event_id"), F.size("vec").cast("long").alias("width"))


def read_captions(spark, sf_dir):
    line = F.concat(F.lit("does "), "event_type", F.lit("#a/DET b/NOUN#"), F.col("frame").cast("string"), F.when(F.col("frame") % 3 == 0, F.lit("#nan")).otherwise(F.concat(F.lit("#"), (F.col("frame") + 0.5).cast("string"))))
    x = readers.captions(spark, _files(spark, _whole(frames(spark, sf_dir), line), "seq_id", "value"))
    return x.select(_key(), F.col("line").cast("long").alias("line"), "caption", F.size("tokens").cast("long").alias("n_tokens"), "start", "stop")


def read_transcripts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat_ws(" ", F.concat(F.lit("d-"), F.col("doc_id").cast("string")), "lang", "source").alias("value"))
    return readers.sentence_texts(spark, _lines(spark, d))


def read_structure(spark, sf_dir):
    """Conversations of users 2k and 2k + 1 in one JSON object; those of one user are left out."""
    u = table(spark, sf_dir, "events").select("user_id").distinct().groupBy(F.floor(F.col("user_id") / 2).cast("string").alias("conv_id")).agg(F.array_sort(F.collect_list(F.col("user_id").cast("string"))).alias("files"))
    whole = u.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("conv_id", "files")))).alias("value"))
    return readers.conversation_structure(spark, _lines(spark, whole))


def write_keyed(spark, sf_dir):
    return writers.keyed(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "key")


def write_cache(spark, sf_dir):
    path = _folder(spark)
    writers.write_cache(table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("lang"), F.col("lang")).alias("meta")), path)
    return spark.read.parquet(path)


def write_resumed(spark, sf_dir):
    """Two runs over overlapping rows: each key is written once."""
    path, d = _folder(spark), table(spark, sf_dir, "documents").select("doc_id", "source")
    writers.append_new(d.where("doc_id % 3 = 0").withColumn("run", F.lit(1)), path, "doc_id")
    writers.append_new(d.withColumn("run", F.lit(2)), path, "doc_id")
    return spark.read.parquet(path)


def write_id_list(spark, sf_dir):
    path = _folder(spark)
    writers.write_ids(table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id")), path, ["d1", "d5", "none"])
    return spark.read.option("header", True).csv(path)


def write_motion(spark, sf_dir):
    path = _folder(spark)
    writers.write_motion_lines(frames(spark, sf_dir).select("seq_id", "frame", F.array(F.col("event_id") / 2, F.col("frame") + 0.25).alias("vec")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def write_dump(spark, sf_dir):
    path = _folder(spark)
    writers.write_responses(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "lang", "source").alias("response")), path)
    return spark.read.text(path).where("value <> ''").select("value", F.substring(hash_order(F.col("value"), 1), 1, 6).alias("h"))


def read_arrays(spark, sf_dir):
    """Embeddings in array files, two arrays a label; one of each is read again."""
    path = _folder(spark)
    name = F.when(F.col("vec_id") % 2 == 1, "odd").otherwise("even")
    at = F.row_number().over(Window.partitionBy("label", "name").orderBy("vec_id")) - 1
    e = table(spark, sf_dir, "embeddings").withColumn("name", name)
    x = e.select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("file"), "name", at.alias("at"), F.col("embedding").alias("vec"))
    arrays.write_arrays(x, path).count()
    got = arrays.array_rows(spark, path, rows=50).where("name = 'odd'")
    label = F.regexp_extract("file", r"label(\d+)[.]npz", 1).cast("long")
    return got.select(label.alias("label"), "at", F.get("shape", 0).cast("long").alias("width"), F.size("vec").cast("long").alias("n"), *[r6(F.get("vec", i)).alias(f"v{i}") for i in (0, 31, 63)])


def recursive_files(spark, sf_dir):
    """Names of files at any depth, without their suffix."""
    f = frames(spark, sf_dir)
    path = _files(spark, _whole(f, F.col("event_type")), "seq_id", "value").removesuffix("/*")
    x = readers.recursive_ids(spark, path, ".txt")
    return x.select(F.regexp_extract("file", r"key=(\d+)", 1).cast("long").alias("seq_id"), F.col("id").startswith("part-").alias("named"), (~F.col("id").endswith(".txt")).alias("bare"))


def _bvh(spark, sf_dir) -> str:
    """A motion file a user; every fifth has a wrong word in one place."""
    user = F.col("seq_id").cast("string")
    word = F.when(F.col("seq_id") % 5 == 0, "OFSET").otherwise("OFFSET")
    head = F.concat(F.lit("HIERARCHY\nROOT Hips\n{\n OFFSET 0 "), user, F.lit(" 0.5\n CHANNELS 3 Xposition Zrotation Yrotation\n JOINT Left-Foot\n {\n  "), word, F.lit(" 1e1 -2 .25\n  CHANNELS 1 Xrotation\n  End Site\n  {\n   OFFSET 0 0 "), user, F.lit("\n  }\n }\n}\nMOTION\nFrames: "), F.count("*").cast("string"), F.lit("\nFrame Time: 0.04\n"))
    line = F.concat_ws(" ", "event_id", "frame", F.col("frame") / 4, F.lit("-1.5e2"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame", line.alias("line")))), lambda x: x["line"]), "\n")
    texts = frames(spark, sf_dir).groupBy("seq_id").agg(F.concat(head, body).alias("value"))
    return _files(spark, texts, "seq_id", "value")


def read_hierarchy(spark, sf_dir):
    x = bvh.bvh_hierarchy(spark, _bvh(spark, sf_dir))
    return x.select(_key(), "joint", "parent", *[F.get("offset", i).alias(f"o{i}") for i in range(3)], F.array_join("channels", " ").alias("channels"), "rotation_order", "error")


def write_hierarchy(spark, sf_dir):
    """Motion files of users, written with a hierarchy and read again by the grammar."""
    bones = [bvh.Bone("Hips", None, [0, 1, 0.5], ["Xposition", "Yrotation"]), bvh.Bone("Leg", "Hips", [0, -1, 0], ["Zrotation"]), bvh.Bone("Leg_Nub", "Leg", [0, -1, 0]), bvh.Bone("Arm", "Hips", [1, 0, 0], [])]
    path = _folder(spark)
    f = frames(spark, sf_dir).select("seq_id", "frame", F.array(F.col("event_id"), F.col("frame") / 4, F.col("value")).alias("values"))
    writers.write_bvh(f, bones, path, 0.04)
    texts = stored(bvh.texts(spark, f"{path}/*"))  # files are many and small, so opening them once counts
    user = F.regexp_extract("file", r"seq_id=(\d+)", 1).cast("long").alias("seq_id")
    joints = bvh.bvh_hierarchy(spark, texts).groupBy(user).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("<", "joint", "parent"))), " ").alias("joints"))
    rows = bvh.bvh_frames(spark, texts).select(user, "frame", *[r6(F.get("values", i)).alias(f"v{i}") for i in range(3)], "error")
    return rows.join(joints, "seq_id")


def read_bvh_frames(spark, sf_dir):
    """Frames 2 to 5 of motion files, and what is wrong with those that have none."""
    x = bvh.bvh_frames(spark, _bvh(spark, sf_dir), 2, 6)
    return x.select(_key(), "frame", r6(F.col("t")).alias("t"), *[F.get("values", i).alias(f"v{i}") for i in range(4)], "error")


QUERIES = {f.__name__: f for f in (read_jsonl, read_ids, read_rules, read_word_vectors, read_semantic, read_intervals, read_faces, read_motion, read_raw_motion, read_captions, read_transcripts, read_structure, write_keyed, write_cache, write_resumed, write_id_list, write_motion, write_dump, read_arrays, recursive_files, read_hierarchy, read_bvh_frames, write_hierarchy)}
_F = f"WITH {FRAMES} SELECT seq_id, "
ORACLE = {
    "read_jsonl": "SELECT 'conv_' || conv_id || '-' || turn AS sample_id, conv_id || '-' || turn AS conv_id, md5(text) AS text_md5 FROM conversations",
    "read_ids": "SELECT 's' || doc_id AS id FROM documents WHERE doc_id % 9 <> 0",
    "read_rules": "SELECT doc_id || '_' || source AS id, CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS type FROM documents",
    "read_word_vectors": "SELECT 'w' || vec_id AS word, " + ", ".join(f"CAST(round(embedding[{i + 1}] * 1000) AS BIGINT) AS v{i}" for i in range(4)) + " FROM embeddings WHERE vec_id % 5 <> 0",
    "read_semantic": "SELECT CAST(event_id AS VARCHAR) AS name, user_id / 2 AS start_time, user_id / 2 + 1.5 AS end_time, CAST(1.5 AS DOUBLE) AS duration, CAST(user_id % 7 AS DOUBLE) AS score, event_type AS keywords FROM events",
    "read_intervals": _F + "CAST(frame AS INTEGER) AS idx, frame / 2 AS start, frame / 2 + 0.5::DOUBLE AS stop, 'say \"' || event_type || '\"' AS mark FROM frames",
    "read_faces": _F + "CAST(frame AS INTEGER) AS frame, event_id AS w0, frame AS w1 FROM frames",
    "read_motion": _F + "CAST(frame AS INTEGER) AS frame, round(frame * 0.04::DOUBLE, 6) + 0.0 AS t, unnest(['Hips_Xposition', 'Hips_Yposition', 'Foot_Zrotation']) AS channel, unnest([CAST(event_id AS DOUBLE), frame, frame / 4]) AS value FROM frames",
    "read_raw_motion": _F + "CAST(frame + 12 AS INTEGER) AS line, event_id, CAST(3 AS BIGINT) AS width FROM frames WHERE (frame + 12) % 4 = 0",
    "read_captions": _F + "frame AS line, 'does ' || event_type AS caption, CAST(2 AS BIGINT) AS n_tokens, CAST(frame AS DOUBLE) AS start, CASE WHEN frame % 3 = 0 THEN 0 ELSE frame + 0.5::DOUBLE END AS stop FROM frames",
    "read_transcripts": "SELECT 'd-' || doc_id AS id, lang || ' ' || source AS text FROM documents",
    "read_structure": "WITH u AS (SELECT DISTINCT user_id FROM events), p AS (SELECT user_id, user_id // 2 AS c, COUNT(*) OVER (PARTITION BY user_id // 2) AS n, row_number() OVER (PARTITION BY user_id // 2 ORDER BY CAST(user_id AS VARCHAR)) - 1 AS k FROM u) SELECT CAST(c AS VARCHAR) AS conv_id, CAST(k AS INTEGER) AS k, CAST(user_id AS VARCHAR) AS file FROM p WHERE n = 2",
    "write_keyed": "SELECT doc_id, printf('%05d', row_number() OVER (ORDER BY doc_id) - 1) AS key FROM documents",
    "write_cache": "SELECT doc_id, '{\"lang\":\"' || lang || '\"}' AS meta FROM documents",
    "write_resumed": "SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS run FROM documents",
    "write_id_list": "SELECT 'd' || doc_id AS id FROM documents WHERE doc_id NOT IN (1, 5)",
    "write_motion": f"WITH {FRAMES} SELECT printf('%.6f %.6f', event_id / 2, frame + 0.25::DOUBLE) AS line FROM frames",
    "write_dump": "WITH v AS (SELECT '== ' || doc_id || ' ==' AS value FROM documents UNION ALL SELECT lang || '/' || source FROM documents) SELECT value, substr(md5(value || ':1'), 1, 6) AS h FROM v",
    "read_arrays": f"""WITH {VECTORS}, v AS (SELECT *, row_number() OVER (PARTITION BY label, vec_id % 2 ORDER BY vec_id) - 1 AS "at" FROM vectors)
SELECT CAST(label AS BIGINT) AS label, "at", CAST(64 AS BIGINT) AS width, CAST(len(vec) AS BIGINT) AS n, round(vec[1], 6) + 0.0 AS v0, round(vec[32], 6) + 0.0 AS v31, round(vec[64], 6) + 0.0 AS v63 FROM v WHERE vec_id % 2 = 1""",
    "write_hierarchy": _F + "CAST(frame AS INTEGER) AS frame, CAST(event_id AS DOUBLE) AS v0, frame / 4 AS v1, round(value, 6) + 0.0 AS v2, NULL AS error, 'Arm<Hips Hips Leg<Hips Leg_Nub<Leg' AS joints FROM frames",
    "recursive_files": "SELECT DISTINCT user_id AS seq_id, TRUE AS named, TRUE AS bare FROM events",
    "read_hierarchy": """WITH u AS (SELECT DISTINCT user_id AS seq_id FROM events)
SELECT seq_id, 'Hips' AS joint, NULL AS parent, 0.0::DOUBLE AS o0, CAST(seq_id AS DOUBLE) AS o1, 0.5::DOUBLE AS o2, 'Xposition Zrotation Yrotation' AS channels, 'ZY' AS rotation_order, NULL AS error FROM u WHERE seq_id % 5 <> 0
UNION ALL SELECT seq_id, 'Left-Foot', 'Hips', 10, -2, 0.25, 'Xrotation', 'X', NULL FROM u WHERE seq_id % 5 <> 0
UNION ALL SELECT seq_id, 'Left-Foot_Nub', 'Left-Foot', 0, 0, seq_id, '', '', NULL FROM u WHERE seq_id % 5 <> 0
UNION ALL SELECT seq_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'line 8: expected OFFSET, found ''OFSET''' FROM u WHERE seq_id % 5 = 0""",
    "read_bvh_frames": _F + "CAST(frame AS INTEGER) AS frame, round((frame - 2) * 0.04::DOUBLE, 6) + 0.0 AS t, CAST(event_id AS DOUBLE) AS v0, CAST(frame AS DOUBLE) AS v1, frame / 4 AS v2, -150.0::DOUBLE AS v3, NULL AS error FROM frames WHERE seq_id % 5 <> 0 AND frame BETWEEN 2 AND 5 UNION ALL SELECT DISTINCT user_id, NULL::INTEGER, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 'line 8: expected OFFSET, found ''OFSET''' FROM events WHERE user_id % 5 = 0",
}
