"""Word classes, twists, nested padding, audio statistics, masks: against loops and on odd rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import layouts
from weftline.functions import rotations as R
from weftline.functions.words import CLASSES, LEXICON, one_hot, split_tagged
from weftline.operators import corpus, features, metrics, skeleton


def test_every_class_and_other(spark):
    words = [(w, "NOUN") for ws in LEXICON.values() for w in ws] + [("thing", c) for c in CLASSES] + [("thing", "ODD"), ("thing", None), (None, "VERB"), ("unheard", "VERB")]
    x = spark.createDataFrame(words, "word string, tag string")
    known = spark.createDataFrame([(w,) for w, _ in words if w and w != "unheard"], "word string")
    got = {(r.word, r.tag): (r.word_class, r.class_vec) for r in corpus.word_classes(x, known).collect()}
    own = {w: c for c, ws in LEXICON.items() for w in ws}
    for w, t in words:
        want = "OTHER" if w in (None, "unheard") else own.get(w) or (t if t in CLASSES else "OTHER")
        assert got[w, t] == (want, [int(c == want) for c in CLASSES])
    assert {c for c, _ in got.values()} == set(CLASSES)
    other = spark.createDataFrame([("thing", "Act_VIP"), ("thing", "VERB"), ("thing", "NO CLASS")], "word string, class string")
    assert {r.word_class for r in corpus.word_classes(x.where("word = 'thing'"), None, other).collect()} == {"VERB"}  # the first class
    word, tag = split_tagged(F.lit("arm/NOUN"))
    r = spark.range(1).select(word.alias("w"), tag.alias("t"), one_hot(F.lit(None).cast("string")).alias("v")).first()
    assert (r.w, r.t, r.v.index(1)) == ("arm", "NOUN", CLASSES.index("OTHER"))


def test_twist_is_the_nearest_turn_about_the_axis(spark):
    r = random.Random(1)
    axis = (2 / 3, -1 / 3, 2 / 3)
    rows = [[r.gauss(0, 1) for _ in range(4)] for _ in range(30)]
    rows = [[x / math.sqrt(sum(y * y for y in q)) for x in q] for q in rows] + [[0.0, 1 / math.sqrt(5), 2 / math.sqrt(5), 0.0], [1.0, 0.0, 0.0, 0.0]]
    got = spark.createDataFrame([(q,) for q in rows], "q array<double>").select("q", R.twist(F.col("q"), axis).alias("t"), R.multiply(R.swing(F.col("q"), axis), R.twist(F.col("q"), axis)).alias("back")).collect()
    for x in got[:30]:
        assert np.allclose(x.back, x.q)
        turns = [[math.cos(a), *[math.sin(a) * c for c in axis]] for a in np.linspace(0, 2 * math.pi, 2001)]
        assert np.dot(x.q, x.t) >= max(np.dot(x.q, t) for t in turns) - 1e-12
    assert got[30].t == [0.0, *[-c for c in axis]] and got[31].t == [1.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_padding_in_every_dimension(spark, depth):
    r = random.Random(depth)
    make = lambda d: r.random() if d == 0 else [make(d - 1) for _ in range(r.randint(0, 3))]
    rows = [(i, i % 3, make(depth)) for i in range(30)] + [(30, 0, None), (31, 7, []), (32, 8, None)]
    kind = "array<" * depth + "double" + ">" * depth
    got = {x.i: x for x in features.pad_nested(spark.createDataFrame(rows, f"i int, b int, x {kind}"), "b", "x", depth).collect()}

    def sizes(x, d):
        return [] if d == 0 else [len(x or []), *[max(s) for s in zip(*[sizes(y, d - 1) for y in x or []], strict=True)]] + [0] * (d - 1 if not x else 0)

    for b in {x[1] for x in rows}:
        own = {i: sizes(x, depth) for i, c, x in rows if c == b}
        most = [max(s) for s in zip(*own.values(), strict=True)]
        for i, c, x in rows:
            if c == b:
                want = np.zeros(most)
                def put(at, y):  # noqa: B023, E306
                    for k, z in enumerate(y or []):
                        if isinstance(z, list):
                            put((*at, k), z)  # noqa: B023
                        else:
                            want[(*at, k)] = z  # noqa: B023
                put((), x)
                assert list(got[i].sizes) == own[i]
                assert np.array(got[i].x, dtype=float).reshape(want.shape).tolist() == want.tolist()


def test_audio_statistics_against_a_loop(spark):
    r = np.random.default_rng(4)
    clips = [(i, r.standard_normal(2 * n).tolist()) for i, n in enumerate([50, 1, 0, 7, 300])]
    rows = [*clips, (5, None), (6, [1.0, None])]
    got = metrics.audio_statistics(spark.createDataFrame(rows, "i int, samples array<double>"), 16, 4, 12, channels=2).first()
    n, l1, total, squares, spec = 0, 0.0, 0.0, 0.0, []
    hann = np.pad(0.5 - 0.5 * np.cos(2 * np.pi * np.arange(12) / 12), 2)
    for _, x in clips:
        x = np.array(x)
        n, l1, total, squares = n + len(x), l1 + np.abs(x).sum(), total + x.sum(), squares + (x * x).sum()
        mono = x.reshape(-1, 2).mean(1)
        if not len(mono):
            spec.append(0.0)
            continue
        padded = np.pad(mono, 8, mode="reflect") if len(mono) > 1 else np.repeat(mono, 17)
        spec.append(math.sqrt(sum((np.abs(np.fft.rfft(padded[a : a + 16] * hann)) ** 2).sum() for a in range(0, len(padded) - 15, 4))))
    assert (got.n_clips, got.n_seen) == (5, n)
    assert [got.l1, got.l2, got.spec] == pytest.approx([l1 / n, squares / n - (total / n) ** 2, np.mean(spec)])
    assert metrics.audio_statistics(spark.createDataFrame([], "i int, samples array<double>"), key="i").collect() == []


def test_sentinels_of_runs(spark):
    r = random.Random(6)
    masks = [[r.random() < 0.5 for _ in range(r.randint(0, 30))] for _ in range(40)] + [[], [True], [False], [True] * 5]
    got = spark.createDataFrame([(i, m) for i, m in enumerate(masks)], "i int, m array<boolean>").select("i", layouts.sentinels(F.col("m"), 100).alias("s")).collect()
    for x in got:
        want, k = [], 0
        for j, m in enumerate(masks[x.i]):
            begins = m and not (j and masks[x.i][j - 1])
            k += begins
            want.append(100 - k if begins else -1 if m else 0)
        assert x.s == want


def test_odd_poses_and_vectors_are_left_out(spark):
    nan = float("nan")
    poses = [(1, 0, [0.0] * 3, [1.0, 0.0, 0.0, 0.0] * 2), (1, 1, None, [1.0, 0.0, 0.0, 0.0] * 2), (1, 2, [0.0] * 3, None), (1, 3, [0.0] * 3, [1.0] * 4), (1, 4, [0.0, nan, 0.0], [1.0, 0.0, 0.0, 0.0] * 2), (1, 5, [1.0, 2.0, 3.0], [0.0] * 8)]
    x = skeleton.forward_kinematics(spark.createDataFrame(poses, "seq_id int, frame int, root array<double>, quats array<double>"), [-1, 0], [[0, 0, 0], [0, 1, 0]])
    assert {r.frame: r.positions for r in x.collect()} == {0: [0, 0, 0, 0, 1, 0], 5: [1, 2, 3, 1, 3, 3]}
    vectors = [[1.0, 2.0], [3.0, 6.0], [1.0, 2.0, 3.0], None, [], [nan, 1.0], [None, 1.0]]
    mean, cov, n = metrics.moments(spark.createDataFrame([(v,) for v in vectors], "vec array<double>").repartition(4))
    assert n == 2 and mean.tolist() == [2.0, 4.0] and cov.tolist() == [[2.0, 4.0], [4.0, 8.0]]
    assert metrics.moments(spark.createDataFrame([(None,)], "vec array<double>"))[2] == 0


def test_frechet_of_odd_sides(spark):
    r = np.random.default_rng(8)
    a, b = r.standard_normal((200, 3)), r.standard_normal((150, 3)) * [1, 2, 3] + 1
    frame = lambda rows: spark.createDataFrame([(v if v is None else [float(x) for x in v],) for v in rows], "vec array<double>")
    (m1, c1), (m2, c2) = [(x.mean(0), np.cov(x.T)) for x in (a, b)]
    e = np.linalg.eigvals(c1 @ c2).real
    want = ((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * np.sqrt(np.maximum(e, 0)).sum()
    assert metrics.frechet(frame([*a, None, [1.0]]), frame([*b, [1.0, 2.0]])) == pytest.approx(want)
    assert metrics.frechet(frame([None]), frame(b)) is None
    flat = [[1.0, 2.0, 3.0]] * 5
    assert metrics.frechet(frame(flat), frame(flat)) == pytest.approx(0)


def test_derived_fields_and_reasons(spark):
    x = spark.createDataFrame([(1, 5.0), (2, None)], "i int, a double")
    d = corpus.Derived().field("b", ("a",), F.col("a") + 1).field("c", ("b", "i"), F.col("b") * F.col("i")).field("bad", ("worse",), F.lit(1)).field("worse", ("bad",), F.lit(1))
    assert d.order(["c"], x.columns) == ["b", "c"]
    assert [tuple(r) for r in d.select(x, "i", "c").orderBy("i").collect()] == [(1, 6.0), (2, None)]
    with pytest.raises(ValueError, match="needs itself"):
        d.select(x, "bad")
    with pytest.raises(KeyError):
        d.select(x, "none")
    rules = [("low", F.col("a") < 9), ("odd", F.col("i") % 2 == 1)]
    assert {r.i: r.reason for r in corpus.with_reasons(x, rules).collect()} == {1: "low", 2: "kept"}
    r = spark.range(1).select(corpus.id_piece(F.lit("a_b.c.npz"), 1, ".npz").alias("p"), corpus.id_piece(F.lit("a_b"), 5).alias("n")).first()
    assert (r.p, r.n) == ("b.c", None)
