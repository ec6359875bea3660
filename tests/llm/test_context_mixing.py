"""The language model: exact counts, proper probabilities, a loop for the mixer, held-out gain."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("weftline.llm")

from weftline.llm import _text  # noqa: E402
from weftline.llm import context_mixing as C  # noqa: E402

SCHEMA = "doc_id long, text string, held_out string, block int, `a.b` int"
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def split(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(LOWER))


def make_rows(n=150, seed=5):
    r = random.Random(seed)
    parts = [["th", "e", "in", "on", "er", "an", "wh"], ["eau", "qu", "ion", "é", "le", "ou"]]
    word = lambda p: "".join(r.choice(p) for _ in range(r.randint(1, 3)))
    rows = [(i, " ".join(word(parts[i % 2]) for _ in range(r.randint(1, 60)))) for i in range(n)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "The THE the"), (None, "no id"), (7, rows[7][1]), (1004, "x" * 30_000), (1005, "\n".join(["again and again"] * 900)), (1006, "naïve 😀 ß x")]
    return rows


ROWS = make_rows()


def table(spark, rows):
    return spark.createDataFrame([(i, t, "h", 3, 4) for i, t in rows], SCHEMA).repartition(3)


def out_of_training(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def test_base_counts(spark):
    got = C.score_documents(table(spark, ROWS)).collect()
    count = collections.Counter()
    for i, t in ROWS:
        if not out_of_training(i):
            count.update([*split(t), b"\n"])
    n, v = sum(count.values()), len(count)
    want = sorted(((i, out_of_training(i), len(x), sum(count[w] > 0 for w in x), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), 6)) for i, t in ROWS for x in [[*split(t), b"\n"]]), key=repr)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    for r in got:
        size = len((dict(ROWS)[r.doc_id] or "").encode())
        assert r.bits_per_byte == (pytest.approx(-r.score / math.log10(2) / size) if size else None)
    again = {(r.doc_id, r.n_tokens): r.score for r in C.score_documents(table(spark, ROWS).repartition(1)).collect()}
    assert all(again[r.doc_id, r.n_tokens] == pytest.approx(r.score, rel=1e-9) for r in got)


def test_held_out_texts_are_predicted(spark):
    got = [r for r in C.score_documents(table(spark, make_rows(600))).collect() if r.held_out and r.n_tokens > 10]
    assert len(got) > 80
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_tables_without_training_or_rows(spark):
    rows = [(i, "some words") for i in range(300) if out_of_training(i)]
    got = C.score_documents(table(spark, rows)).collect()
    assert {(r.held_out, r.n_known, r.train_tokens, r.base_score) for r in got} == {(True, 0, 0, 0.0)}
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert C.score_documents(table(spark, [])).collect() == []


def words_of(*words):
    return C.flat(b"".join(w + b" " for w in words))


def texts_of(texts):
    raw = [t.encode() for t in texts]
    return C.tokens_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def model_of(texts, log2=16):
    """A model as `train` makes it, one decision at a time."""
    words = collections.Counter(w for t in texts for w in [*split(t), b"\n"])
    pairs = collections.Counter()
    for w, n in words.items():
        s = b"  " + w + b" "
        for k in range(2, len(s)):
            pairs[(s[k - 2] << 8 | s[k - 1]) << 9 | s[k]] += n
    keys = np.array(sorted(pairs), np.int64)
    codes = C.build_codes(keys, np.array([pairs[k] for k in keys.tolist()], np.int64))
    zero, one = collections.Counter(), collections.Counter()

    def add(spelled, n, tail=None):
        w = C.spell(C.Flat(np.frombuffer(spelled, np.uint8), np.array([len(spelled)])), codes)
        for h in [w.four, w.whole] if tail is None else [w.whole + C._text.mix(np.array([tail + 1]))[0]]:
            for slot, bit in zip((h >> np.uint64(64 - log2)).tolist(), w.bit.tolist(), strict=True):
                (one if bit else zero)[slot] += n

    for w, n in words.items():
        add(w + b" ", n)
    for t in texts:
        for a, b in itertools.pairwise([b"\n", *split(t), b"\n"]):
            add((b + b" ")[: C.ACROSS], 1, int.from_bytes(a[-2:], "big"))
    slots = np.zeros(1 << log2, np.int16)
    for s in {*zero, *one}:
        logit = max(min(math.log((one[s] + 0.4) / (zero[s] + 0.4)), C.MOST_LOGIT), -C.MOST_LOGIT)
        slots[s] = round(logit * C.STEPS) * 8 + min((zero[s] + one[s]).bit_length(), 7)
    return C.Model(codes, slots, sum(words.values()), len(words))


def test_training_is_that_of_a_loop(spark):
    texts = [t or "" for _, t in ROWS[:40]] + ["", "The end the END"]
    rows = [(i, t) for i, t in zip([i for i in range(200) if not out_of_training(i)], texts, strict=False)]
    want = model_of([t for _, t in rows])
    x = texts_of([t for _, t in rows])
    packed = [(bytearray(C.zstandard.compress(x.words.data.tobytes())), bytearray(C._pack(np.bincount(x.tokens, minlength=len(x.words.ends)))))]
    pairs = [(int(a), int(n)) for a, n in zip(*C.joints(x, np.ones(len(x.tokens), bool)), strict=True)]
    got = C.train(spark.createDataFrame(packed, "words binary, counts binary"), spark.createDataFrame(pairs, "joint long, n long"), 16)
    assert (got.n, got.v) == (want.n, want.v)
    assert all((a == b).all() for a, b in zip(got.codes, want.codes, strict=True))
    assert np.abs(got.slots.astype(int) - want.slots).max() <= 8  # a logit may round to its neighbour


def brute_bits(text, model, segment):
    """The mixer, one decision at a time."""
    log2, f = len(model.slots).bit_length() - 1, np.float32
    decisions, before = [], b"\n"
    for word in [*split(text), b"\n"]:
        w = C.spell(words_of(word), model.codes)
        tail = C._text.mix(np.array([int.from_bytes(before[-2:], "big") + 1]))[0]
        for k in range(len(w.bit)):
            slot = lambda h: int(model.slots[int(h) >> (64 - log2)])
            across = slot((int(w.whole[k]) + int(tail)) & ((1 << 64) - 1)) >> 3 if w.place[k] < C.ACROSS else 0
            decisions.append((int(w.bit[k]), min(int(w.place[k]), C.ACROSS), slot(w.four[k]) >> 3, slot(w.whole[k]), across, int(w.whole[k]) & ((1 << C.ONLINE_SLOTS) - 1)))
        before = word
    bits = 0.0
    for k, (bit, place, four, whole, across, cell) in enumerate(decisions):
        if k % segment == 0:
            weights, online, refined = {}, {}, {}
        kind = int(C._CLASS[whole & 7])
        gate = place * 4 + kind
        p = online.get(cell, f(0.5))
        x = np.array([four * C.SCALE, (whole >> 3) * C.SCALE, C._LOGITS[int(p * f(4095))], across * C.SCALE], np.float32)
        online[cell] = p + (f(bit) - p) * C.ONLINE_RATE
        w = weights.setdefault(gate, C.FIRST[0 if place < C.ACROSS else 1][kind].copy())
        dot = w[0] * x[0] + w[1] * x[1] + w[2] * x[2] + w[3] * x[3]
        q = f(1) / (f(1) + np.exp(-dot))
        weights[gate] = w + (f(bit) - q) * C.MIXER_RATE * x
        at = (kind, int(min(max(dot, f(-8)), f(8)) * f(2) + f(16.5)))
        r = refined.get(at, f(1 / (1 + math.exp(-(at[1] - 16) / 2))))
        refined[at] = r + (f(bit) - r) * C.REFINE_RATE
        q = q + (r - q) * C.PART
        bits += math.log2(min(max(abs(1 - bit - q), 1 / 4096), 1 - 1 / 4096))
    return bits


@pytest.mark.parametrize(("segment", "lanes"), [(2048, 16384), (50, 16384), (7, 3)])
def test_mixer_is_that_of_a_loop(monkeypatch, segment, lanes):
    monkeypatch.setattr(C, "LANES", lanes)
    model = model_of([t or "" for _, t in ROWS[:60]])
    texts = [t or "" for _, t in ROWS[50:75]] + ["", "new Wörds zzz 😀", "b" * 40]
    got = C.score_texts(texts_of(texts), model, segment)
    assert got.tolist() == pytest.approx([brute_bits(t, model, segment) for t in texts], rel=1e-4)


def test_spelling_is_a_prefix_code():
    model = model_of(["the then a aab", "eau"])
    for context in [(32, 32), (32, ord("t")), (ord("t"), ord("h")), (1, 2)]:
        row = model.codes.rows[context[0] << 8 | context[1]]
        total = 0.0
        for s in range(256):
            u = model.codes.unit[row, s]
            size = model.codes.size[u] if u >= 0 else 8 + (model.codes.size[model.codes.unit[row, 256]] if model.codes.unit[row, 256] >= 0 else 0)
            total += 2.0 ** -int(size)
        assert total <= 1 + 1e-12


def test_words_are_told_apart_by_their_bytes(monkeypatch):
    data = np.frombuffer(b"aa bb aa " + b"c" * 200 + b" " + b"c" * 199 + b"d", np.uint8)
    starts, ends, _ = _text.words(data, np.array([0, len(data)]))
    for hashes in (_text.span_hashes, lambda d, a, b: np.zeros(len(a), np.uint64)):
        monkeypatch.setattr(C._text, "span_hashes", hashes)
        first, of = C.distinct(data, starts, ends)
        assert [data[starts[k] : ends[k]].tobytes() for k in first[of]] == [b"aa", b"bb", b"aa", b"c" * 200, b"c" * 199 + b"d"]


def test_repeated_and_long_texts_grow_cheap(spark):
    (row,) = [r for r in C.score_documents(table(spark, ROWS)).collect() if r.doc_id == 1005]
    assert row.n_tokens == 2701
    assert row.bits_per_byte < 0.5


def test_packed_numbers_come_back():
    for x in (np.arange(0, dtype=np.int64), np.array([1, -5, 1 << 60], np.int64), np.arange(70_000, dtype=np.uint32)):
        assert (C._unpack(C._pack(x), x.dtype.type) == x).all()
