"""Readers and writers on small files, and the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.sources import readers, writers
from weftline.streaming import windows


def test_text_readers(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" a \nb\n\n")
    assert sorted(r.id for r in readers.id_list(spark, f"{tmp_path}/ids.txt").collect()) == ["a", "b"]
    (tmp_path / "w.txt").write_text("the 1 2 3\nbad 1 2\nno x y z\nof 4 5 6\n")
    assert {r.word: r.vec for r in readers.word_vectors(spark, f"{tmp_path}/w.txt", 3).collect()} == {"the": [1, 2, 3], "of": [4, 5, 6]}
    (tmp_path / "c.txt").write_text("a man walks#a/DET man/NOUN#0.0#nan\n")
    r = readers.captions(spark, f"{tmp_path}/c.txt").first()
    assert (r.caption, r.tokens, r.start, r.stop) == ("a man walks", ["a/DET", "man/NOUN"], 0.0, 0.0)
    (tmp_path / "s.tsv").write_text("01\t0.5\t1.5\t1.0\t0.7\thand\n")
    assert readers.semantic_scores(spark, f"{tmp_path}/s.tsv").first().score == 0.7


def test_json_readers(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"conv_id": "7", "text": "hi"}\n')
    assert readers.jsonl_texts(spark, f"{tmp_path}/t.jsonl").first().sample_id == "conv_7"
    (tmp_path / "m.json").write_text('{"c1": ["a", "b"], "c2": ["only"]}')
    assert sorted((r.conv_id, r.k, r.file) for r in readers.conversation_structure(spark, f"{tmp_path}/m.json").collect()) == [("c1", 0, "a"), ("c1", 1, "b")]
    (tmp_path / "f.json").write_text('{"frames": [{"weights": [0.1, 0.2], "time": 0}, {"weights": [0.3, 0.4], "time": 1}]}')
    assert [r.weights for r in readers.facial_frames(spark, f"{tmp_path}/f.json").orderBy("frame").collect()] == [[0.1, 0.2], [0.3, 0.4]]
    both = readers.read_all(spark, [("jsonl_texts", f"{tmp_path}/t.jsonl"), ("conversation_structure", f"{tmp_path}/m.json")])
    assert both.count() == 3 and "file" in both.columns


def test_textgrid(spark, tmp_path):
    (tmp_path / "a.TextGrid").write_text('File type = "ooTextFile"\nitem []:\n    item [1]:\n        class = "IntervalTier"\n        xmin = 0\n        xmax = 2\n        intervals: size = 2\n        intervals [1]:\n            xmin = 0\n            xmax = 1.5\n            text = "say ""hi"""\n        intervals [2]:\n            xmin = 1.5\n            xmax = 2\n            text = ""\n')
    rows = readers.word_intervals(spark, str(tmp_path / "a.TextGrid")).orderBy("idx").collect()
    assert [(r.start, r.stop, r.mark) for r in rows] == [(0.0, 1.5, 'say "hi"'), (1.5, 2.0, "")]


def test_bvh(spark, tmp_path):
    (tmp_path / "m.bvh").write_text("HIERARCHY\nROOT Hips\n{\n OFFSET 0 0 0\n CHANNELS 3 Xposition Yposition Zposition\n JOINT Spine\n {\n  CHANNELS 1 Xrotation\n  End Site\n  {\n  }\n }\n}\nMOTION\nFrames: 2\nFrame Time: 0.5\n1 2 3 4\n5 6 7 8\n")
    rows = readers.bvh_motion(spark, f"{tmp_path}/m.bvh").orderBy("frame", "value").collect()
    assert [(r.frame, r.t, r.channel, r.value) for r in rows][3:5] == [(0, 0.0, "Spine_Xrotation", 4.0), (1, 0.5, "Hips_Xposition", 5.0)]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "id int, v string")
    assert [r.key for r in writers.keyed(rows, "id").orderBy("id").collect()] == [f"{i:05d}" for i in range(20)]
    path = f"{tmp_path}/t"
    writers.append_new(rows.where("id < 10"), path, "id")
    writers.append_new(rows, path, "id")
    assert spark.read.parquet(path).count() == 20
    writers.write_cache(spark.sql("SELECT 1 AS id, map('a', 1) AS m"), f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c").first().m == '{"a":1}'


def stream(spark, frame, tmp_path, name, files):
    source = f"{tmp_path}/{name}"
    for part in files:
        part.coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)


def drained(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_silence_splitter(spark, tmp_path):
    loud, quiet = [1.0] * 5, [0.0] * 12
    rows = spark.createDataFrame([(0, 0, loud + quiet[:6], False), (0, 1, quiet[6:] + loud, False), (0, 2, loud, True)], "stream_id int, seq int, samples array<double>, last boolean")
    s = stream(spark, rows, tmp_path, "chunks", [rows.where(f"seq = {k}") for k in range(3)])
    got = drained(spark, windows.split_at_silence(s, rate=100, silence=0.1), "silence_test").orderBy("part").collect()
    assert [len(r.samples) for r in got] == [17, 10]


def test_stream_equals_batch(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    s = stream(spark, e, tmp_path, "events", [e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")])
    got = drained(spark, windows.online_means(s.withColumn("w", F.lit(1.0)), "event_type", "value", "w"), "means_test", "complete")
    want = windows.online_means(e.withColumn("w", F.lit(1.0)), "event_type", "value", "w")
    key = lambda rows: sorted((r.event_type, round(r["mean"], 6), r.weight) for r in rows.collect())
    assert key(got) == key(want)


def test_codebook_merge(spark, tmp_path):
    path = f"{tmp_path}/book"
    windows.start_codebook(spark.createDataFrame([(0, 0, 1.0, 2.0, 2.0)], "code long, i int, count double, total double, value double"), path)
    batch = spark.createDataFrame([(0, [4.0])], "code long, vec array<double>")
    for _ in range(2):  # a batch that is tried again
        windows.merge_codebook(batch, 0, path, 0.5)
    new = windows.codebook_at(spark, path).first()
    assert (new["count"], new.total, new.value) == (1.0, 3.0, 3.0)
    assert windows.codebook_at(spark, path, 0).first().total == 2.0


def test_silence_splitter_against_a_loop(spark, tmp_path):
    import random

    import numpy as np

    r, least = random.Random(5), 10
    chunks = [(s, i, [r.choice((0.0, 0.0, 0.0, 0.001, 1.0)) if r.random() < 0.3 else 0.0 for _ in range(r.randint(1, 40))], i == 11) for s in range(6) for i in range(12)]
    rows = spark.createDataFrame(chunks, "stream_id int, seq int, samples array<double>, last boolean")
    got = drained(spark, windows.split_at_silence(stream(spark, rows, tmp_path, "loop", [rows.where(f"seq = {k}") for k in range(12)]), rate=100, silence=0.1), "silence_loop").collect()
    want = []
    for s in range(6):
        buffer, part = [], 0
        for _, _, samples, last in [c for c in chunks if c[0] == s]:
            buffer, cut = buffer + samples, 0
            db = lambda x: 20 * np.log10(np.maximum(np.abs(x), 1e-5) / max(np.abs(x).max(), 1e-5))
            if last:
                cut = len(buffer)
            else:
                silent = np.flatnonzero(db(np.array(buffer)) < -40)
                for i in range(len(silent) - least, -1, -1):
                    if (np.diff(silent[i : i + least]) == 1).all():
                        rest = db(np.array(buffer[silent[i] :]))
                        cut = int(silent[i] + np.flatnonzero(rest >= -40)[0])
                        break
            if cut:
                want.append((s, part, buffer[:cut]))
                buffer, part = buffer[cut:], part + 1
    assert sorted((x.stream_id, x.part, list(x.samples)) for x in got) == sorted(want) and len(want) > 12


def test_keys_beyond_five_digits(spark):
    keys = [r.key for r in writers.keyed(spark.range(100_500).withColumnRenamed("id", "n"), "n").orderBy("n").select("key").collect()]
    assert keys[7] == "00007" and keys[-1] == "100499" and len(set(keys)) == 100_500


def test_raw_lines_and_texts(spark, tmp_path):
    (tmp_path / "m.bvh").write_text("head\nhead\n" + "\n".join(f"{i} {i + 0.5}" for i in range(2, 9)) + "\n")
    assert [(r.line, r.vec) for r in readers.raw_motion_lines(spark, f"{tmp_path}/m.bvh", 2, 3).orderBy("line").collect()] == [(3, [3.0, 3.5]), (6, [6.0, 6.5])]
    (tmp_path / "t.txt").write_text("1-2-3 HELLO THE WORLD\n\n1-2-4 AGAIN\n")
    assert sorted(map(tuple, readers.sentence_texts(spark, f"{tmp_path}/t.txt").collect())) == [("1-2-3", "HELLO THE WORLD"), ("1-2-4", "AGAIN")]
    writers.write_responses(spark.createDataFrame([(2, "b"), (1, None)], "id int, response string"), f"{tmp_path}/dump")
    assert spark.read.text(f"{tmp_path}/dump").count() == 6


def test_fading_overlaps_against_a_loop(spark, tmp_path):
    import random

    import numpy as np

    r, n = random.Random(7), 4
    chunks = [(s, i, [r.random() for _ in range(r.randint(n, 12))], i == 4) for s in range(3) for i in range(5)]
    rows = spark.createDataFrame(chunks, "stream_id int, seq int, samples array<double>, last boolean")
    got = drained(spark, windows.fade_overlaps(stream(spark, rows, tmp_path, "fade", [rows.where(f"seq = {k}") for k in range(5)]), n), "fade_loop").collect()
    w, want = np.hamming(2 * n), []
    for s in range(3):
        held = None
        for _, i, samples, last in [c for c in chunks if c[0] == s]:
            x = [a * w[k] + held[k] * w[n + k] if held and k < n else a for k, a in enumerate(samples)]
            want.append((s, i, [round(float(a), 9) for a in (x if last else x[:-n])]))
            held = None if last else x[-n:]
    assert sorted((x.stream_id, x.part, [round(a, 9) for a in x.samples]) for x in got) == sorted(want)


def test_array_files(spark, tmp_path):
    import numpy as np
    import pytest

    from weftline.sources import arrays

    path = str(tmp_path)
    np.save(tmp_path / "cube.npy", np.arange(24).reshape(4, 3, 2))
    np.save(tmp_path / "columns.npy", np.asfortranarray(np.arange(6.0).reshape(3, 2)))
    np.save(tmp_path / "one.npy", np.float32(7))
    np.save(tmp_path / "none.npy", np.zeros((0, 3)))
    (tmp_path / "deep").mkdir()
    np.savez_compressed(tmp_path / "deep" / "z.npz", a=np.arange(3000), b=np.ones((2, 2), bool))
    got = arrays.array_rows(spark, path, rows=2)
    of = lambda f, n=None: [(r.at, list(r.shape), r.vec) for r in got.orderBy("at").collect() if r.file.endswith(f) and r.name == n]
    assert of("cube.npy") == [(i, [3, 2], [float(6 * i + k) for k in range(6)]) for i in range(4)]
    assert of("columns.npy") == [(i, [2], [2.0 * i, 2.0 * i + 1]) for i in range(3)]
    assert of("one.npy") == [(0, [], [7.0])] and of("none.npy") == []
    assert of("z.npz", "a") == [(i, [], [float(i)]) for i in range(3000)]
    assert got.where("name = 'b'").select("vec").collect() == [([1.0, 1.0],)] * 2
    (tmp_path / "bad").mkdir()
    np.save(tmp_path / "bad" / "o.npy", np.array([{}, None]), allow_pickle=True)
    with pytest.raises(Exception, match="never unpickled"):
        arrays.array_rows(spark, f"{path}/bad").collect()
    cut = (tmp_path / "cube.npy").read_bytes()[:-8]
    (tmp_path / "bad" / "o.npy").write_bytes(cut)
    with pytest.raises(Exception, match="ends within"):
        arrays.array_rows(spark, f"{path}/bad").collect()


def test_arrays_are_written_whole(spark, tmp_path):
    from weftline.sources import arrays

    rows = spark.range(100).selectExpr("concat('f', id % 3) AS file", "CASE WHEN id % 3 = 0 THEN NULL ELSE concat('n', id % 2) END AS name", "id AS at", "array(id, 2.5 * id) AS vec")
    assert sorted((r.file.rsplit("/")[-1], r.n) for r in arrays.write_arrays(rows, f"{tmp_path}/a").collect()) == [("f0.npy", 34), ("f1.npz", 33), ("f2.npz", 33)]
    assert sorted(x.vec[0] for x in arrays.array_rows(spark, f"{tmp_path}/a").collect()) == list(range(100))
    assert [f for f in arrays.array_files(f"{tmp_path}/a") if f.endswith(".part")] == []


BVH = "HIERARCHY\nROOT Hips\n{\n OFFSET 0 0 .5\n CHANNELS 2 Xposition Zrotation\n JOINT A.b-c\n {\n  OFFSET 1e-1 -2 3\n  CHANNELS 1 Xrotation\n  End Site\n  {\n   OFFSET 0 1 0\n  }\n }\n JOINT B { OFFSET 1 1 1 CHANNELS 0 }\n}\nMOTION\nFrames: 3\nFrame Time: 0.5\n0 1 2\n3 4 5\n6 7 8\n"


def test_motion_grammar(spark, tmp_path):
    from weftline.sources import bvh

    texts = {"good": BVH, "word": BVH.replace("OFFSET 1e-1", "OFSET 1"), "brace": BVH.replace("}\nMOTION", "MOTION"), "mark": BVH.replace("End", "§"), "short": BVH[:-3], "number": BVH.replace("4", "x4"), "deep": "HIERARCHY ROOT r { OFFSET 0 0 0 " + "".join(f"JOINT j{i} {{ OFFSET 0 0 0 " for i in range(3000)) + "}" * 3001}
    for name, text in texts.items():
        (tmp_path / f"{name}.bvh").write_text(text)
    name = F.regexp_extract("file", r"(\w+)[.]bvh", 1).alias("name")
    joints = bvh.bvh_hierarchy(spark, str(tmp_path)).select(name, "*").collect()
    assert [(r.joint, r.parent, r.offset, r.channels, r.rotation_order) for r in joints if r.name == "good"] == [("Hips", None, [0, 0, 0.5], ["Xposition", "Zrotation"], "Z"), ("A.b-c", "Hips", [0.1, -2, 3], ["Xrotation"], "X"), ("A.b-c_Nub", "A.b-c", [0, 1, 0], [], ""), ("B", "Hips", [1, 1, 1], [], "")]
    wrong = {r.name: r.error for r in joints if r.error}
    assert wrong == {"word": "line 8: expected OFFSET, found 'OFSET'", "brace": "line 16: expected JOINT, End Site or a closing brace, found 'MOTION'", "mark": "line 10: unexpected '§'"}
    assert sum(r.name == "deep" for r in joints) == 3001
    rows = bvh.bvh_frames(spark, str(tmp_path), 1, 3).select(name, "*").collect()
    assert [(r.frame, r.t, r.values) for r in rows if r.name == "good"] == [(1, 0.0, [3, 4, 5]), (2, 0.5, [6, 7, 8])]
    assert {r.name: r.error for r in rows if r.error and r.name in ("short", "number")} == {"short": "2 of 3 frames are whole", "number": "frame 1: 'x4' is no number"}
    assert len([r for r in rows if r.name == "short" and r.values]) == 1


def test_tokens_come_once_over_a_restart(spark, tmp_path):
    import numpy as np

    from weftline.streaming import tokens

    (tmp_path / "in").mkdir()
    source, sink, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    for k in range(4):
        np.save(tmp_path / "in" / f"{k:03d}.npy", np.arange(100 * k, 100 * k + 50))
        if k != 1:
            tokens.run_to_end(tokens.token_stream(spark, source, 7), sink, state)
    tokens.run_to_end(tokens.token_stream(spark, source, 7), sink, state)  # nothing is new
    got = spark.read.parquet(sink).orderBy("at").collect()
    assert [(r.at, r.token) for r in got] == [(50 * k + i, 100 * k + i) for k in range(4) for i in range(50)]
    tokens.write_batch(spark.range(3).selectExpr("id AS at", "id AS token"), 0, sink)
    tokens.write_batch(spark.range(3).selectExpr("id AS at", "id AS token"), 0, sink)  # a batch that is tried again
    assert spark.read.parquet(sink).where("batch = 0").count() == 3


def test_idle_streams_are_flushed_by_a_timer(spark, tmp_path):
    """Stream 0 falls silent without a last chunk; later events of stream 1 move the time on."""
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    chunks = [(0, k, [1.0] * 4, False, at(k)) for k in range(3)] + [(1, k, [1.0] * 4, k == 9, at(60 * k)) for k in range(10)]
    rows = spark.createDataFrame(chunks, "stream_id int, seq int, samples array<double>, last boolean, at string").selectExpr("* EXCEPT (at)", "CAST(at AS timestamp) AS ts")
    s = stream(spark, rows, tmp_path, "idle", [rows.where("stream_id = 0"), rows.where("stream_id = 1 AND seq < 5"), rows.where("seq >= 5")])
    out = windows.split_at_silence(s, rate=100, silence=0.1, idle="90 seconds", late="1 second")
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {(r.stream_id, r.part): len(r.samples) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(0, 0): 12, (1, 0): 40}


def test_prompts_against_a_loop(spark):
    import random

    r = random.Random(2)
    streams = {s: [[r.randrange(99) for _ in range(r.randint(0, 40))] for _ in range(30)] for s in range(3)}
    blocks = spark.createDataFrame([(s, i, t) for s, bs in streams.items() for i, t in enumerate(bs)], "stream_id int, block int, tokens array<int>")
    x = windows.growing_prompts(blocks, 64)
    got = {(r.stream_id, r.block): r.prompt for r in windows.prompt_of(x, blocks).collect()}
    for s, bs in streams.items():
        for i in range(len(bs)):
            assert got[s, i] == [t for b in bs[:i] for t in b][-64:]
    assert windows.prompt_of(x, blocks.limit(0)).collect() == []


def test_clips_meet_their_frames(spark):
    from weftline.sources import corpora

    frames = spark.createDataFrame([(s, f, float(1000 * s + f)) for s in range(3) for f in range(50 * (s + 1))], "seq_id int, frame int, x double")
    spans = [(s, c, a, min(a + n, 50 * (s + 1))) for s in range(3) for c, (a, n) in enumerate([(0, 1), (0, 64), (63, 2), (40, 100), (10, 0)]) if a < 50 * (s + 1)]
    got = corpora._arrays(frames, spark.createDataFrame(spans, "seq_id int, clip int, start int, stop int"), ["x"], ["seq_id", "clip"]).collect()
    assert {(r.seq_id, r.clip): r.x for r in got} == {(s, c): [float(1000 * s + f) for f in range(a, b)] for s, c, a, b in spans if b > a}


def test_hierarchy_round_trip_and_listed_clips(spark, tmp_path):
    from weftline.sources import bvh, corpora

    bones = [bvh.Bone("r", None, [0.0, 1.5, 0.0], ["Xposition", "Zrotation"]), bvh.Bone("a", "r", [1.0, 0.0, 0.0], ["Yrotation"]), bvh.Bone("a_Nub", "a", [0.0, 0.5, 0.0]), bvh.Bone("b", "r", [0.0, 0.0, 1.0], [])]
    frames = spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0]), (1, 1, [4.0, 5.0, 6.5]), (2, 0, [0.0] * 3), (2, 1, [0.0] * 2), (3, 0, None)], "seq_id int, frame int, values array<double>")
    writers.write_bvh(frames, bones, f"{tmp_path}/m", 0.02)
    joints = bvh.bvh_hierarchy(spark, f"{tmp_path}/m/*").where("file LIKE '%seq_id=1/%'").collect()
    assert [(j.joint, j.parent, j.offset, j.channels, j.error) for j in joints] == [(b.name, b.parent, b.offset, b.channels, None) for b in bones]
    rows = bvh.bvh_frames(spark, f"{tmp_path}/m/*").collect()
    assert sorted((r.frame, r.values, r.error) for r in rows) == [(0, [0.0] * 3, None), (0, [1.0, 2.0, 3.0], None), (1, [4.0, 5.0, 6.5], None)]
    clips = spark.createDataFrame([("a", [1]), ("b", [2]), ("a", []), ("c", None)], "seq_id string, x array<int>")
    ids = spark.createDataFrame([("M_a",), ("M_c",), ("M_a",), ("none",)], "id string")
    assert [(r.seq_id, r.x) for r in corpora.listed_clips(clips, ids, "M_", ["x"]).collect()] == [("a", [1])]


def test_stages_go_and_come_back(spark):
    from weftline.operators import stages

    v = spark.createDataFrame([(i, [float(i), 2.0, float(i * i)]) for i in range(6)], "vec_id int, vec array<double>")
    chain = stages.Chain((stages.Standardized(), stages.Masked((1, 0, 1)))).fit(v)
    back = {r.vec_id: r.vec for r in chain.inverse(chain.transform(v)).collect()}
    assert all(abs(a - b) < 1e-9 for i in range(6) for a, b in zip(back[i], [i, 2.0, i * i], strict=True))
    t = spark.createDataFrame([(0, f, c, float(f * k)) for f in range(4) for k, c in enumerate(("Hips_Xposition", "Hips_Yposition", "Leg_Zrotation"))], "track int, frame int, channel string, value double")
    chain = stages.Chain((stages.WithoutConstants(), stages.RootDeltas())).fit(t)
    there = chain.transform(t)
    assert {r.channel for r in there.collect()} == {"Hips_Yposition", "Leg_Zrotation"}
    assert sorted(map(tuple, chain.inverse(there).select("track", "frame", "channel", "value").collect())) == sorted(map(tuple, t.collect()))


def test_word_vectors_round_as_floats(spark, tmp_path):
    from weftline import plans

    values = [-0.2765, 0.2765, 0.0125, 0.0]  # as floats, each of the first two times 1000 is a half
    spark.createDataFrame([(1, values), (5, values)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in plans.queries()["read_word_vectors"](spark, str(tmp_path)).collect()] == [("w1", -277, 277, 13, 0)]


def test_texts_lie_where_spark_puts_them(spark, tmp_path):
    """The folders of partitionBy, one file each; a second run replaces the first."""
    rows = spark.createDataFrame([("a/b:c", "1\n2"), ("é %=?", "3"), ("x", ""), (None, "4"), ("", "5"), ("none", None)], "k string, value string")
    for path in (f"{tmp_path}/a folder", f"file:{tmp_path}/b", f"file://{tmp_path}/c/"):
        writers.write_texts(rows.withColumn("value", F.lit("old")).unionByName(spark.createDataFrame([("gone", "x")], rows.schema)), "k", path)
        writers.write_texts(rows, "k", path)
        got = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").collect()
        rows.where("value IS NOT NULL").write.mode("overwrite").partitionBy("k").text(f"{tmp_path}/spark")
        want = spark.read.text(f"{tmp_path}/spark", wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").collect()
        assert sorted((r.file.split("/")[-2], r.value) for r in got) == sorted((r.file.split("/")[-2], r.value) for r in want)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a folder", "b", "c", "spark"]
    assert not list((tmp_path / "b").rglob("*.crc"))


def test_motion_files_are_listed_once(spark, tmp_path, monkeypatch):
    from weftline.plans import files
    from weftline.sources import bvh

    texts, read = bvh.texts, []
    monkeypatch.setattr(bvh, "texts", lambda *a: read.append(a) or texts(*a))
    assert files.write_hierarchy(spark, "/root/testdata/sf0.001").count() == 1000
    assert len(read) == 1
