"""Golden cases and properties of the operator library."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.functions import rotations as R
from weftline.functions import tokens as T
from weftline.operators import align, clips, codes, corpus, features, kinematics, metrics, turns


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lit(values):
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<int>")


def test_parsing(spark):
    text = F.lit("<|audio_1|><|face_2|><|upper_3|>")
    r = one(spark, audio=T.parse_tokens(text, "audio"), face=T.parse_tokens(text, "face"), hand=T.parse_tokens(text, "hand"), bad=T.parse_single(F.lit("invalid")), good=T.parse_single(F.lit("<|face_456|>")), large=T.parse_tokens(F.lit("<|audio_99999999999|>"), "audio"))
    assert (r.audio, r.face, r.hand, r.bad, r.good, r.large) == ([1], [2], [], None, 456, [])


def test_combining(spark):
    a, b = lit([1, 2, 3]), lit([9, 8])
    m = T.interleave(a, b, 1024)
    r = one(spark, m=m, c=T.fit(T.concat(a, b, 1024), 7), low=T.separate(lit([1, 1033, 2]), 1024)[0], high=T.separate(lit([1, 1033, 2]), 1024)[1], none=T.interleave(lit([]), b, 10), up=T.upsample(a, 2), down=T.downsample(lit([0, 1, 2, 3, 4]), 2), pool=T.mean_pool(lit([1, 2, 4, 4, 9]), 2))
    assert r.m == [1, 1033, 2, 1032, 3] and r.c == [1, 2, 3, 1033, 1032, 0, 0]
    assert (r.low, r.high, r.none) == ([1, 2], [9], [19, 18])
    assert (r.up, r.down, r.pool) == ([1, 1, 2, 2, 3, 3], [0, 2, 4], [1, 4])


def test_masks(spark):
    r = one(spark, a=T.length_mask(F.lit(1), F.lit(3)), b=T.length_mask(F.lit(3), F.lit(3)), none=T.length_mask(F.lit(0), F.lit(0)), o=T.offset_masked(lit([1, 2]), lit([True, False]), 10))
    assert (r.a, r.b, r.none, r.o) == ([True, False, False], [True, True, True], [], [11, 2])


def test_token_counts(spark):
    text = "<|user|>\n<|audio_1|><|face_2|> hello world <|x|>\n<|assistant|> ok"
    assert one(spark, n=T.count_tokens(F.lit(text))).n == 2 + 2 + 2 + 3
    assert one(spark, n=T.count_tokens(F.lit(""))).n == 0


def frames(spark, values, seq=0):
    return spark.createDataFrame([(seq, i, float(v)) for i, v in enumerate(values)], "seq_id int, frame int, value double")


def column(df, expr):
    return [r.x for r in df.select("frame", expr.alias("x")).orderBy("frame").collect()]


def test_kinematics(spark):
    f = frames(spark, [0, 1, 4, 9])
    assert column(f, kinematics.velocity()) == [1, 2, 4, 5]
    assert column(frames(spark, [7]), kinematics.velocity()) == [0]
    assert column(frames(spark, [1, 2, 4, 5]), kinematics.position()) == [0, 1, 3, 7]
    assert column(f, kinematics.contact(threshold=2)) == [1, 0, 0, 1]
    assert column(f.withColumn("value", kinematics.delta()), kinematics.integrate()) == [0, 1, 4, 9]
    low = kinematics.local_minima(frames(spark, [3, 1, 2, 0, 5, 5, 5, 4]), 1)
    assert [r.frame for r in low.orderBy("frame").collect()] == [1, 3]


def test_speaking_turns(spark):
    values = [1] * 3 + [0] * 9 + [1] * 2 + [0] * 10 + [1]
    got = turns.speaking_turns(frames(spark, values)).orderBy("start").collect()
    assert [(r.start, r.stop) for r in got] == [(0, 14), (24, 25)]
    assert turns.speaking_turns(frames(spark, [0, 0, 0])).collect() == []
    tail = turns.speaking_turns(frames(spark, [1, 1, 0, 0, 0]), gap=10).first()
    assert (tail.start, tail.stop) == (0, 5)
    cut = turns.speaking_turns(frames(spark, [1, 1] + [0] * 12), gap=10).first()
    assert (cut.start, cut.stop) == (0, 2)


def loop_turns(values, threshold, gap):
    top = max(map(abs, values))
    loud = [abs(v) / top >= threshold for v in values] if top else []
    out, i = [], 0
    while i < len(loud):
        if not loud[i]:
            i += 1
            continue
        start, silent, j = i, 0, i
        while j < len(loud) and silent < gap:
            silent = 0 if loud[j] else silent + 1
            j += 1
        out.append((start, j - silent if silent >= gap else j))
        i = j
    return out


def test_speaking_turns_equal_the_loop(spark):
    r = random.Random(4)
    for _ in range(6):
        values = [r.choice([0, 0, 0, 1, 5]) for _ in range(120)]
        got = turns.speaking_turns(frames(spark, values), 0.3, 4).orderBy("start").collect()
        assert [(x.start, x.stop) for x in got] == loop_turns(values, 0.3, 4)


def sequences(spark, *n):
    return spark.createDataFrame(list(enumerate(n)), "seq_id int, n int")


def test_clips(spark):
    got = clips.clip_slices(sequences(spark, 140, 50, 10)).collect()
    assert [(r.seq_id, r.start) for r in got] == [(0, 0), (0, 20), (0, 40), (0, 60)]
    assert clips.paired_chunks(sequences(spark, 26)).count() == 0
    assert clips.paired_chunks(sequences(spark, 26), inclusive=True).count() == 1
    assert [(r.start, r.stop) for r in clips.fixed_chunks(sequences(spark, 1700, 0)).collect()] == [(0, 800), (800, 1600), (1600, 1700)]
    assert [(r.start, r.stop) for r in clips.segments_or_whole(sequences(spark, 400, 1000)).orderBy("seq_id", "clip").collect()] == [(0, 400), (0, 500), (250, 750), (500, 1000)]
    f = frames(spark, range(5))
    assert [r.frame for r in clips.every_kth(f, 2, drop_last=True).orderBy("frame").collect()] == [0, 2]
    assert clips.every_kth(frames(spark, range(105)), 8).count() == 14


def chat(spark, roles):
    return spark.createDataFrame([(0, i, r, f"t{i}") for i, r in enumerate(roles)], "conv_id int, turn int, role string, text string")


def test_rounds(spark):
    c = chat(spark, ["system", "assistant", "user", "assistant", "user", "user", "assistant", "assistant", "user", "assistant"])
    assert turns.rounds(c).count() == 3
    assert turns.round_windows(c, 2).count() == 2
    assert turns.round_windows(c, 4).count() == 0
    first = turns.rounds(c).where("round = 1").first().text
    assert first == "<|user|>\nt5<|assistant|>\nt6<|assistant|>\nt7"


def test_budget_prefix_equals_the_loop(spark):
    r = random.Random(1)
    texts = [" ".join("w" for _ in range(r.randint(1, 40))) for _ in range(30)]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "conv_id int, turn int, text string")
    used, want = 49, []
    for i, t in enumerate(texts):
        used += len(t.split())
        if used > 300:
            break
        want.append(i)
    assert sorted(r.turn for r in turns.budget_prefix(df, 300).collect()) == want


def test_paragraphs(spark):
    s = spark.createDataFrame([(0, i, f"s{i}", float(a), float(b)) for i, (a, b) in enumerate([(0, 4), (5, 9), (9, 11), (11, 30), (30, 32)])], "seq_id int, sentence int, text string, start double, stop double")
    got = turns.merge_paragraphs(s, 10.0).orderBy("paragraph").collect()
    assert [(r.text, r.start, r.stop) for r in got] == [("s0 s1", 0, 9), ("s2", 9, 11), ("s3", 11, 30), ("s4", 30, 32)]


def test_vocabulary(spark):
    d = spark.createDataFrame([(0, "a b a, c"), (1, None), (2, "")], "doc_id int, text string")
    v = corpus.vocabulary(corpus.tokens_of(d))
    assert {r.word: (r.id, r.n) for r in v.collect()} == {"a": (4, 2), "b": (5, 1), "c": (6, 1)}
    t = corpus.encode_words(spark.createDataFrame([("a",), ("zz",)], "word string"), v)
    assert {r.word: r.id for r in t.collect()} == {"a": 4, "zz": 3}
    other = spark.createDataFrame([("b", 9, 4), ("d", 9, 5)], "word string, n long, id long")
    assert {r.word: (r.id, r.n) for r in corpus.merge_vocabularies(v, other).collect()} == {"a": (4, 2), "b": (5, 2), "c": (6, 1), "d": (7, 1)}


def test_every_task_is_kept(spark):
    pairs = corpus.with_tasks(spark.range(3).select(F.col("id").alias("conv_id")), spark.range(1500).select(F.col("id").alias("task")))
    assert pairs.count() == pairs.distinct().count() == 4500


def test_split_shares(spark):
    got = corpus.random_split(spark.range(1000), "id").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 800, "val": 100, "test": 100}


def test_alignment(spark):
    p = spark.createDataFrame([(0, 0.5), (0, 2.0), (0, 9.0)], "seq_id int, t double")
    iv = spark.createDataFrame([(0, 0, 0.0, 2.0, "a"), (0, 1, 1.0, 3.0, "b")], "seq_id int, idx int, start double, stop double, mark string")
    got = {r.t: r.mark for r in align.first_interval(p, iv, "mark", 1.0, "none").collect()}
    assert got == {0.5: "a", 2.0: "a", 9.0: "none"}
    words = spark.createDataFrame([(0, 0, 0.0, 1.0, "x"), (0, 1, 0.5, 2.0, "y"), (0, 2, 1.0, 2.0, "z")], "seq_id int, idx int, start double, stop double, mark string")
    clip = spark.createDataFrame([(0, 0, 0.0, 1.0), (0, 1, 5.0, 6.0)], "seq_id int, clip int, start double, stop double")
    assert {r.clip: r.words for r in align.contained_words(clip, words, 1.0).collect()} == {0: "x", 1: ""}
    near = align.nearest(p, p.where("t > 1"))
    assert {r.t: r.distance for r in near.collect()} == {0.5: 1.5, 2.0: 0.0, 9.0: 0.0}


def test_codes(spark):
    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 1.0]), (2, [0.5, 0.5])], "vec_id long, vec array<double>")
    book = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 1.0])], "code long, vec array<double>")
    c = codes.nearest_code(v, book)
    assert {r.vec_id: r.code for r in c.collect()} == {0: 0, 1: 1, 2: 0}
    four = spark.createDataFrame([(0,), (0,), (1,), (1,)], "code int")
    assert codes.perplexity(four).first().perplexity == pytest.approx(2.0, abs=1e-5)


def test_features(spark):
    v = spark.createDataFrame([(0, [1.0, 5.0, 2.0]), (1, [3.0, 5.0, 4.0])], "vec_id int, vec array<double>")
    s = features.channel_statistics(v)
    assert [r.i for r in features.constant_channels(s).collect()] == [1]
    back = features.standardize(features.standardize(v, s), s, inverse=True).orderBy("vec_id").collect()
    assert [r.vec for r in back] == [[1.0, 5.0, 2.0], [3.0, 5.0, 4.0]]
    r = one(spark, a=features.mask_scatter(features.mask_select(lit([1.0, 2.0, 3.0]), [1, 0, 1]), [1, 0, 1]), line=features.resize_linear(lit([0.0, 2.0]), 5))
    assert r.a == [1.0, 0.0, 3.0] and r.line == [0.0, 0.5, 1.0, 1.5, 2.0]


def test_rotation_round_trips(spark):
    r = random.Random(3)
    rows = [([r.gauss(0, 1) for _ in range(4)], [r.uniform(-1.5, 1.5) for _ in range(3)]) for _ in range(40)]
    rows += [([1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0]), ([0.0, 1.0, 0.0, 0.0], [1e-9, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "q array<double>, a array<double>")
    m = R.quaternion_to_matrix(F.col("q"))
    got = df.select("q", "a", R.matrix_to_quaternion(m).alias("q2"), R.matrix_to_axis_angle(R.axis_angle_to_matrix(F.col("a"))).alias("a2"), R.slerp(F.col("q"), F.col("q"), 0.3).alias("same")).collect()
    for x in got:
        n = math.sqrt(sum(v * v for v in x.q))
        s = -1 if x.q[0] < 0 else 1
        assert x.q2 == pytest.approx([s * v / n for v in x.q], abs=1e-7)
        assert x.a2 == pytest.approx(x.a, abs=1e-6)


def test_procrustes_undoes_a_similarity(spark):
    r = random.Random(2)
    truth = [r.gauss(0, 1) for _ in range(15)]
    turn = lambda x, y, z: (-2 * y + 1, 2 * x - 3, 2 * z + 5)
    pred = [v for i in range(0, 15, 3) for v in turn(*truth[i : i + 3])]
    df = spark.createDataFrame([(0, 0, pred, truth)], "seq_id int, frame int, pred array<double>, truth array<double>")
    assert metrics.procrustes_errors(df).first().pa_mpjpe == pytest.approx(0, abs=1e-6)
    assert metrics.joint_errors(df.withColumn("pred", F.col("truth")), 5).first().mpjpe == 0


def test_frechet_of_equal_sets_is_zero(spark):
    r = random.Random(5)
    v = spark.createDataFrame([([r.gauss(0, 1) for _ in range(4)],) for _ in range(200)], "vec array<double>")
    assert metrics.frechet(v, v) == pytest.approx(0, abs=1e-6)
    moved = v.select(F.transform("vec", lambda x: x + 2).alias("vec"))
    assert metrics.frechet(v, moved) == pytest.approx(16, abs=1e-6)


def test_bit_scales_against_a_loop(spark):
    r = np.random.default_rng(3)
    rows, want = [], []
    for seq in range(4):
        x = r.normal(size=(7 + seq, 5))
        rows += [(seq, i, v.tolist()) for i, v in enumerate(x)]
        for level, scale in enumerate((1, 3, 7)):
            n = len(x)
            parts = [x[i * n // scale : -(-(i + 1) * n // scale)].mean(0) for i in range(scale)]
            want += [(seq, level, i, "".join("1" if v > 0 else "0" for v in p)) for i, p in enumerate(parts)]
            signs = np.array([[1 if v > 0 else -1 for v in p] for p in parts]) / np.sqrt(5)
            for i in range(n):
                at = min(max((i + 0.5) * scale / n - 0.5, 0), scale - 1)
                low, t = int(at), at - int(at)
                x[i] -= signs[low] * (1 - t) + signs[min(low + 1, scale - 1)] * t
    got = codes.scale_bits(spark.createDataFrame(rows, "seq_id int, frame int, vec array<double>"), [1, 3, 7])
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_nearest_code_of_many_codes_and_odd_vectors(spark):
    book = [(i, [float(i // 2), 0.0]) for i in range(200)]  # every value twice
    vectors = [(0, [3.2, 0.0]), (1, None), (2, [None, 1.0]), (3, [1.0]), (4, [99.0, 5.0]), (5, [-7.0, 0.0])]
    got = codes.nearest_code(spark.createDataFrame(vectors, "vec_id long, vec array<double>"), spark.createDataFrame(book, "code long, vec array<double>"))
    assert {r.vec_id: r.code for r in got.collect()} == {0: 6, 1: None, 2: None, 3: None, 4: 198, 5: 0}


def test_all_tasks_of_each_row(spark):
    assert corpus.with_tasks(spark.range(3), spark.range(1500).withColumnRenamed("id", "task")).count() == 4500


def test_ranks_agree_in_every_evaluation(spark):
    words = spark.range(3000).select((F.col("id") % 40).alias("doc_id"), F.floor(F.col("id") / 40).alias("pos"), F.concat(F.lit("w"), F.pmod(F.xxhash64("id"), F.lit(700)).cast("string")).alias("word"))
    rows, first = words.collect(), {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.pos)):
        first.setdefault(r.word, len(first) + 4)
    for parts in (1, 7):
        assert {r.word: r.id for r in corpus.vocabulary(words.repartition(parts)).collect()} == first
    capped = corpus.fraction_cap(spark.range(1000).select((F.col("id") % 3).alias("g"), F.pmod(F.col("id") * 7919, F.lit(1000)).alias("k")), "g", "k", 0.3)
    want = {g: sorted(i * 7919 % 1000 for i in range(g, 1000, 3))[: round(len(range(g, 1000, 3)) * 0.3)] for g in range(3)}
    got = {g: sorted(r.k for r in capped.where(f"g = {g}").collect()) for g in range(3)}
    assert got == want


def test_fraction_cap_when_rows_come_in_another_order(spark):
    """Each evaluation meets the rows in another order, as with shuffles between executors; ranges stay the same."""
    n = 600_000

    def shuffled(batches):
        yield pd.concat(batches).sample(frac=1)

    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        rows = spark.range(n).mapInPandas(shuffled, "id long").select(F.lit("a").alias("g"), F.col("id").alias("k"))
        got = corpus.fraction_cap(rows, "g", "k", 0.3).agg(F.count("*").alias("n"), F.countDistinct("k").alias("keys"), F.max("k").alias("last")).first()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert (got.n, got["keys"], got["last"]) == (n * 3 // 10, n * 3 // 10, n * 3 // 10 - 1)


def test_fraction_cap_of_missing_keys(spark):
    rows = spark.createDataFrame([("a", None), ("a", 2), ("a", 1), ("a", None), ("b", None), ("b", None)], "g string, k int")
    assert sorted(corpus.fraction_cap(rows, "g", "k", 0.5).collect(), key=str) == [("a", 1), ("a", 2), ("b", None)]


def _cut_texts(n=60):
    """(doc_id, words, pieces): pieces of any length, of which some go over the end of a word."""
    draw, texts = random.Random(3), []
    for i in range(n):
        words = ["".join(draw.choice("abéß漢𝄞") for _ in range(draw.randint(1, 9))) for _ in range(draw.randint(0, 12))]
        whole, pieces = "".join(words), []
        while whole:
            k = draw.randint(1, 4)
            pieces, whole = [*pieces, whole[:k]], whole[k:]
        texts.append((i, words, pieces))
    return [*texts, (n, None, None), (n + 1, ["abc"], None), (n + 2, ["abc"], ["ab"]), (n + 3, ["abc", "d"], ["abc", "d"])]


@pytest.mark.parametrize("at_once", [1, 40, 250_000])
def test_pieces_lie_in_words_as_spans_do(spark, monkeypatch, at_once):
    monkeypatch.setattr(align, "PIECES_AT_ONCE", at_once)
    data = _cut_texts()
    spans = lambda parts: [(sum(map(len, parts[:k])), sum(map(len, parts[: k + 1])), p) for k, p in enumerate(parts)]
    words = [(d, k, a, b) for d, w, _ in data for k, (a, b, _) in enumerate(spans(w or []))]
    pieces = [(d, a, b, p) for d, _, x in data for a, b, p in spans(x or [])]
    got = align.pieces_in_words(spark.createDataFrame(data, "doc_id long, words array<string>, pieces array<string>").coalesce(2))
    want = align.spans_in_words(spark.createDataFrame(words, "doc_id long, idx int, start int, stop int"), spark.createDataFrame(pieces, "doc_id long, start int, stop int, piece string"))
    assert got.dtypes == want.dtypes
    assert sorted(got.collect()) == sorted(want.collect())


def test_subword_spans_exchange_nothing(spark, data):
    from weftline import plans

    assert "Exchange" not in plans.queries()["subword_spans"](spark, data)._jdf.queryExecution().executedPlan().toString()
