"""LM scoring by online logistic context mixing (operator 12).

The tokens of a text are spelled in binary decisions, and several predictors give each
decision a probability; a gated mixer combines them in the logistic domain, learning
from every decision, and an adaptive table refines the result. The sum of the log
probabilities is the score; it is also given as total bits per byte.

* Spelling. A word is its bytes and a space; the end of a text is the word of one line
  feed. Each byte is a path in a Huffman tree that depends on the two bytes
  before it in the word; bytes that training never saw there follow an escape as eight
  plain decisions. So every sequence of tokens has a probability.
* Predictors learned from the corpus. How often a decision fell either way is counted
  under three hashed contexts: the last four bytes, the whole word so far, and, for the
  first ACROSS bytes of a word, these and the last two bytes of the word before. All training tokens count: words, and pairs of an end and a beginning, are
  counted first, and each distinct one spells once with its count. Slots hold the logit
  of the counts and how many there were.
* A predictor learned online. A small table of a segment follows its own decisions, under
  the word so far.
* Mixing. The weights are gated: a set is chosen by the place in the word and by how often
  the whole-word context has seen. After each decision the set moves along the gradient of
  the coding cost. The refinement maps the mixed logit, by gate, to what really came.

A text is scored in segments of SEGMENT decisions, whose online state starts afresh, so that
a very long text, or word, has as many lanes as it has segments; all segments of a block of texts
advance together, one decision at a time, in numpy arrays. Scores don't depend on how
texts are dealt to blocks.

Words are exact in all counts. A block of consecutive texts is one row: its distinct words
with their training counts, and its texts as numbers of these words. Buckets by hash
gather the words of all blocks, add their counts up by their bytes, and answer each block;
there are as many buckets as keep one at BUCKET words on average, so no bucket grows
with the input but by one entry a block for each of its most common words. What is
gathered is the vocabulary, which grows with the input. Only the slots (2 ** MOST_SLOTS
at most, as many as the vocabulary asks for below that) and the Huffman codes (bounded by
the pairs of contexts and bytes) are broadcast. Slots are hashed, as usual in this kind
of model: a fuller table shares slots and predicts less sharply, but no word or text is
left out.

Defined cases: a null or empty text has the end only; a null doc_id belongs to training;
repeated rows are trained on and scored once each; a table without training rows spells
everything in plain decisions of even odds at first; an empty table gives an empty table;
only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import _text
from weftline.llm._graph import cut, table, written

#: Decisions of a segment; bytes of text of a block; lanes that advance together.
SEGMENT, BLOCK, LANES = 2048, 4 << 20, 16384
#: Words of a bucket, and of a task that spells the vocabulary, on average; parts of the slots.
BUCKET, SPELLED, PARTS = 1 << 19, 1 << 20, 64
#: Binary logarithms: most slots of the corpus's counts, and the slots of a segment's table.
MOST_SLOTS, ONLINE_SLOTS = 22, 8
#: Learning rates of the mixer, of the refinement and of the online table.
MIXER_RATE, REFINE_RATE, ONLINE_RATE = np.float32(0.03), np.float32(0.02), np.float32(0.16)
SPACE, END = 32, 10
#: Bytes of a word that are also predicted from the word before.
ACROSS = 2
_ESCAPE = 256
#: A slot's value is its logit in steps of 1/128, and three bits of how much it has seen.
STEPS, MOST_LOGIT = 128, 8.0
#: Sets of weights: places in a word by four classes of what the whole-word context has seen.
GATES = 4 * (ACROSS + 1)
#: Weights at the start, by class: four bytes, word, online, across words; the last row
#: in places that are not predicted across words.
FIRST = np.array([[[1, 0, 0.15, 0], [0.4, 0.4, 0.15, 0.2], [0.2, 0.45, 0.15, 0.35], [0, 0.45, 0.1, 0.5]], [[1, 0, 0.15, 0], [0.5, 0.4, 0.15, 0], [0.3, 0.65, 0.15, 0], [0.05, 0.9, 0.15, 0]]], np.float32)
#: The refinement: cells of a logit from -8 to 8, and its part of the probability.
CELLS, PART = 33, np.float32(0.3)


class Codes(NamedTuple):
    """Paths of bytes: `rows[context]` is the row of `unit` of a context of two bytes (the
    last, if it is new), `unit[row, byte]` the path (-1: none), and [row, 256] its escape's;
    path u has the decisions first[u]:first[u] + size[u]."""

    rows: np.ndarray
    unit: np.ndarray
    first: np.ndarray
    size: np.ndarray
    bit: np.ndarray
    node: np.ndarray


class Words(NamedTuple):
    """The decisions of distinct words: those of word i are first[i]:first[i + 1].

    `four` and `whole` are hashes of the decision and its context.
    """

    first: np.ndarray
    bit: np.ndarray
    place: np.ndarray
    four: np.ndarray
    whole: np.ndarray


def _paths(counts: list[tuple[int, int]]) -> dict[int, list[tuple[int, int]]]:
    """The Huffman paths (node, bit) of symbols with their counts."""
    heap = sorted((n, s) for s, n in counts)
    up, made = {}, 0
    while len(heap) > 1:
        (n, a), (m, b) = heapq.heappop(heap), heapq.heappop(heap)
        up[a], up[b] = (made, 0), (made, 1)
        heapq.heappush(heap, (n + m, 1000 + made))
        made += 1
    out = {}
    for s, _ in counts:
        path, at = [], s
        while at in up:
            path.append(up[at])
            at = 1000 + up[at][0]
        out[s] = path[::-1]
    return out


def build_codes(keys: np.ndarray, counts: np.ndarray) -> Codes:
    """Codes of all seen pairs (context << 9 | byte, sorted), each context's escape, and plain bytes."""
    paths = [[(256 + ((256 | s) >> (8 - k)), (s >> (7 - k)) & 1) for k in range(8)] for s in range(256)]
    contexts = keys >> 9
    edges = [0, *(np.flatnonzero(np.diff(contexts)) + 1).tolist(), len(keys)] if len(keys) else [0]
    rows, unit = np.full(1 << 16, len(edges) - 1, np.int32), np.full((len(edges), 257), -1, np.int32)
    for row, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        rows[contexts[a]] = row
        for s, path in _paths([*zip((keys[a:b] & 511).tolist(), counts[a:b].tolist(), strict=True), (_ESCAPE, 1)]).items():
            unit[row, s] = len(paths)
            paths.append(path)
    size = np.array([len(path) for path in paths], np.int64)
    node, bit = np.array([d for path in paths for d in path], np.int64).T
    return Codes(rows, unit, np.cumsum(size) - size, size, bit.astype(np.uint8), _text.mix(node + 1))


class Flat(NamedTuple):
    """Words, each with a space behind it, one after the other; word i ends at ends[i]."""

    data: np.ndarray
    ends: np.ndarray


def flat(data: bytes | np.ndarray) -> Flat:
    data = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    return Flat(data, np.flatnonzero(data == SPACE) + 1)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.dtype.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _symbols(words: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of words, the word of each, and its place in the word."""
    size = np.diff(words.ends, prepend=0)
    word = np.repeat(np.arange(len(size)), size)
    return words.data, word, np.arange(len(word)) - (words.ends - size)[word]


def _before(data: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The k-th byte before each one in its word; a space before the word."""
    out = np.full(len(data), SPACE, np.int64)
    far = np.flatnonzero(place >= k)
    out[far] = data[far - k]
    return out


def _repeated(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first[i], first[i] + 1, ... of all spans."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - size), size)


def spell(words: Flat, codes: Codes) -> Words:
    """The decisions of words, or of beginnings of words."""
    data, word, place = _symbols(words)
    before = [_before(data, place, k) for k in range(1, 5)]
    row = codes.rows[before[1] << 8 | before[0]]
    unit = codes.unit[row, data].astype(np.int64)
    # one path a byte; where the pair is new, an escape (none in a new context) and a plain byte
    of = np.repeat(np.arange(len(data)), 1 + (unit < 0))
    units = unit[of]
    plain = np.flatnonzero((of[1:] == of[:-1])) + 1
    units[plain], units[plain - 1] = data[of[plain]], codes.unit[row[of[plain]], _ESCAPE]
    size = np.where(units >= 0, codes.size[units], 0)
    at, by = _repeated(codes.first[units], size), np.repeat(of, size)
    four = _text.mix((before[0] | before[1] << 8 | before[2] << 16 | before[3] << 24).astype(np.uint64) + np.uint64(1 << 40))
    whole = _text.rolling_hashes(data, np.arange(len(data)) - place, np.arange(len(data)))
    node = codes.node[at]
    ends = np.concatenate(([0], np.cumsum(np.bincount(word, np.bincount(of, size, len(data)), len(words.ends))))).astype(np.int64)
    return Words(ends, codes.bit[at], place[by], four[by] + node, whole[by] + node)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The span of each distinct word in the order of the hashes, and the number of each span's word.

    Hashes group the spans; their bytes are compared with those of their group's first.
    """
    hashes = _text.span_hashes(data, starts, ends)
    _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    like, same = first[of], size == size[first[of]]
    live = np.flatnonzero(same)
    for k in range(0, int(size.max(initial=0)), 8):
        live = live[size[live] > k]
        keep = _text._KEEP[np.minimum(size[live] - k, 8)]
        same[live] &= (eight[starts[live] + k] & keep) == (eight[starts[like[live]] + k] & keep)
    if same.all():
        return first, of
    raw, seen = data.tobytes(), {}
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        seen.setdefault((int(hashes[i]), raw[a:b]), i)
    number = {key: k for k, key in enumerate(sorted(seen))}
    of = np.array([number[int(h), raw[a:b]] for h, a, b in zip(hashes, starts.tolist(), ends.tolist(), strict=True)], np.int64)
    return np.array([seen[key] for key in sorted(seen)], np.int64), of


class Texts(NamedTuple):
    """The tokens of texts: distinct words (the end is the first, others in the order of their
    hashes), and the words of text i at tokens[at[i]:at[i + 1]]."""

    words: Flat
    tokens: np.ndarray
    at: np.ndarray


def tokens_of(data: np.ndarray, at: np.ndarray) -> Texts:
    """`data` has the bytes of texts, of which text i has at[i]:at[i + 1]."""
    data = _text.ascii_lower(data)
    starts, ends, per = _text.words(data, at)
    first, of = distinct(data, starts, ends)
    size = np.concatenate(([1], (ends - starts)[first]))
    stop = np.cumsum(size + 1)
    words = np.full(stop[-1], SPACE, np.uint8)
    words[0] = END
    words[_repeated((stop - size - 1)[1:], size[1:])] = data[_repeated(starts[first], size[1:])]
    n = np.diff(per) + 1
    tokens, last = np.zeros(int(n.sum()), np.int64), np.cumsum(n) - 1
    inner = np.ones(len(tokens), bool)
    inner[last] = False
    tokens[inner] = of + 1
    return Texts(Flat(words, stop), tokens, np.concatenate(([0], last + 1)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block of texts: their rows, tokens, words with training counts, and joints."""
    block = TaskContext.get().partitionId() << 32

    def row() -> pa.RecordBatch:
        at = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(a) for _, _, a in parts]))))
        x = tokens_of(np.concatenate([d for _, d, _ in parts]), at)
        held_out = np.concatenate([np.asarray(r.column("held_out")) for r, _, _ in parts])
        trains = np.repeat(~held_out, np.diff(x.at))
        key, n = joints(x, trains)
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        ids = pa.concat_arrays([r.column("doc_id") for r, _, _ in parts])
        return pa.record_batch({
            "block": pa.array([block], pa.int64()), "doc_id": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "held_out": one(held_out, pa.bool_()), "size": one(np.diff(at), pa.int64()), "n": one(np.diff(x.at), pa.int64()),
            "tokens": [_pack(x.tokens.astype(np.uint32))], "n_words": pa.array([len(x.words.ends)], pa.int64()), "words": [zstandard.compress(x.words.data.tobytes(), 3)], "counts": [_pack(np.bincount(x.tokens, trains, len(x.words.ends)).astype(np.int64))], "joint": one(key, pa.int64()), "joint_n": one(n, pa.int64()),
        })

    parts, size = [], 0
    for rows, data, at in _text.groups(batches):
        if parts and size + len(data) > BLOCK:
            yield row()
            parts, size, block = [], 0, block + 1
        parts.append((rows, data, at))
        size += len(data)
    if parts:
        yield row()


def _divided(bits: int):
    """Splits the words of blocks by the first bits of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, counts in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                words, counts = flat(zstandard.decompress(words)), _unpack(counts, np.int64)
                starts = words.ends - np.diff(words.ends, prepend=0)
                bucket = (_text.span_hashes(words.data, starts, words.ends - 1) >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)
                bucket[0] = 0  # the end
                edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
                pieces = [(int(bucket[a]), block, a, zstandard.compress(words.data[starts[a] : words.ends[b - 1]].tobytes(), 1), _pack(counts[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.record_batch(dict(zip(("bucket", "block", "first", "words", "counts"), map(list, zip(*pieces, strict=True)), strict=True)))

    return run


def _counted(rows: pa.Table) -> pa.Table:
    """The words of a bucket with their counts over all blocks, by block, and once without a block."""
    raw = [zstandard.decompress(w) for w in rows.column("words").to_pylist()]
    counts = [_unpack(c, np.int64) for c in rows.column("counts").to_pylist()]
    words = flat(b"".join(raw))
    offsets = np.concatenate(([0], words.ends))
    keys = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.ends), [None, pa.py_buffer(offsets), pa.py_buffer(words.data)]).dictionary_encode()
    of = keys.indices.to_numpy()
    total = np.bincount(of, np.concatenate(counts), len(keys.dictionary)).astype(np.int64)
    some = pa.array(total > 0)
    edges = np.cumsum([len(c) for c in counts])[:-1]
    return pa.table({
        "block": pa.chunked_array([rows.column("block").combine_chunks(), pa.nulls(1, pa.int64())]), "first": [*rows.column("first").to_pylist(), 0],
        "words": pa.array([*rows.column("words").to_pylist(), zstandard.compress(b"".join(keys.dictionary.filter(some).to_pylist()), 1)], pa.binary()),
        "counts": pa.array([_pack(c) for c in [*np.split(total[of], edges), total[total > 0]]], pa.binary()),
    })


def tails(words: Flat) -> np.ndarray:
    """The last two bytes of each word, as a number."""
    size, data = np.diff(words.ends, prepend=0), words.data.astype(np.int64)
    return np.where(size > 2, data[np.maximum(words.ends - 3, 0)] << 8, 0) | data[words.ends - 2]


def tail_hashes(words: Flat) -> np.ndarray:
    return _text.mix(tails(words) + 1)


def joints(x: Texts, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, n): ends of words and the ACROSS bytes at the beginning of the next, of the tokens that train."""
    starts, data = x.words.ends - np.diff(x.words.ends, prepend=0), x.words.data.astype(np.int64)
    heads = data[starts] << 8 | data[starts + 1]
    before = np.concatenate((x.tokens[-1:], x.tokens[:-1]))  # an end stands before each text's first word
    return np.unique((tails(x.words)[before] << 16 | heads[x.tokens])[trains], return_counts=True)


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Flat, np.ndarray]]:
    """Words and counts, in parts of a bounded size."""
    for batch in batches:
        for words, counts in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            words, counts = flat(zstandard.decompress(words)), _unpack(counts, np.int64)
            for i in range(0, len(counts), 1 << 16):
                begin, ends = words.ends[i - 1] if i else 0, words.ends[i : i + (1 << 16)]
                yield Flat(words.data[begin : ends[-1]], ends - begin), counts[i : i + (1 << 16)]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of contexts of two bytes and bytes, of words with their counts."""
    for words, counts in _vocabulary(batches):
        data, word, place = _symbols(words)
        keys, of = np.unique((_before(data, place, 2) << 8 | _before(data, place, 1)) << 9 | data, return_inverse=True)
        yield pa.record_batch({"key": keys, "n": np.bincount(of, counts[word], len(keys)).astype(np.int64)})


def logits(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The value of slots from how often a decision was 0 and 1."""
    value = np.clip(np.log((one + 0.4) / (zero + 0.4)), -MOST_LOGIT, MOST_LOGIT)
    seen = np.minimum(np.frexp(zero + one)[1], 7)  # the bits of the count
    return (np.rint(value * STEPS) * 8 + seen).astype(np.int16)


class Model(NamedTuple):
    codes: Codes
    slots: np.ndarray
    n: int
    v: int


def train(vocabulary: DataFrame, joined: DataFrame, most_slots: int = MOST_SLOTS) -> Model:
    """The model of packed (words, counts), the end among them, and of (joint, n)."""
    v_type = "key long, n long"
    pairs = vocabulary.mapInArrow(_pairs, v_type).groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toArrow()
    codes = build_codes(pairs.column("key").to_numpy(), pairs.column("n").to_numpy())
    sizes = vocabulary.select("counts").mapInArrow(_sizes, "v long, n long").agg(F.sum("v"), F.sum("n")).first()
    v, n = sizes[0] or 0, sizes[1] or 0
    log2 = min(max(16, (4 * v).bit_length()), most_slots)
    shift = np.uint64(64 - log2)

    def parts(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The slots that have seen anything, by part of the table."""
        width = len(sums) // PARTS
        for part in range(PARTS):
            own = sums[part * width : (part + 1) * width]
            at = np.flatnonzero(own)
            if len(at):
                yield pa.record_batch({"part": pa.array([part], pa.int32()), "at": pa.array([_pack(at.astype(np.uint32))], pa.binary()), "n": pa.array([_pack(own[at])], pa.binary())})

    def add(sums: np.ndarray, hashes: np.ndarray, bits: np.ndarray, times: np.ndarray) -> None:
        np.add.at(sums, (hashes >> shift).astype(np.int64) * 2 + bits, times)

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 << log2, np.int64)
        for words, counts in _vocabulary(batches):
            w = spell(words, codes)
            times = np.repeat(counts, np.diff(w.first))
            add(sums, w.four, w.bit, times)
            add(sums, w.whole, w.bit, times)
        yield from parts(sums)

    def of_joints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 << log2, np.int64)
        for batch in batches:
            key, counts = batch.column("joint").to_numpy(), batch.column("n").to_numpy()
            data = np.stack((key >> 8 & 255, key & 255), 1).astype(np.uint8).ravel()
            w = spell(Flat(data, np.arange(len(key)) * ACROSS + ACROSS), codes)
            add(sums, w.whole + np.repeat(_text.mix((key >> 16) + 1), np.diff(w.first)), w.bit, np.repeat(counts, np.diff(w.first)))
        yield from parts(sums)

    def together(rows: pa.Table) -> pa.Table:
        sums = np.zeros(2 * (1 << log2) // PARTS, np.int64)
        for at, n in zip(rows.column("at").to_pylist(), rows.column("n").to_pylist(), strict=True):
            sums[_unpack(at, np.uint32)] += _unpack(n, np.int64)
        return pa.table({"part": rows.column("part")[:1], "value": pa.array([logits(sums[::2], sums[1::2]).tobytes()], pa.binary())})

    tasks = max(1, -(-v // SPELLED))
    kind = "part int, at binary, n binary"
    counted = vocabulary.repartition(tasks).mapInArrow(of_words, kind).union(joined.repartition(max(1, tasks // 4)).mapInArrow(of_joints, kind))
    slots = np.zeros(1 << log2, np.int16)
    for row in counted.groupBy("part").applyInArrow(together, "part int, value binary").toLocalIterator():
        value = np.frombuffer(bytes(row.value), np.int16)
        slots[row.part * len(value) : (row.part + 1) * len(value)] = value
    return Model(codes, slots, n, v)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [_unpack(c, np.int64) for c in batch.column("counts").to_pylist()]
        yield pa.record_batch({"v": pa.array([len(c) for c in counts], pa.int64()), "n": pa.array([int(c.sum()) for c in counts], pa.int64())})


#: Of the bits of what a slot has seen.
_CLASS = np.array([0, 1, 2, 2, 3, 3, 3, 3])
SCALE = np.float32(1 / STEPS)
_LOGITS = np.log((np.arange(4096) + 0.5) / (4095.5 - np.arange(4096))).astype(np.float32)


def _logit(value: np.ndarray) -> np.ndarray:
    return (value >> 3) * np.float32(1 / STEPS)


class Lanes(NamedTuple):
    """The decisions of segments in the order of time: step i has those at first[i]:first[i + 1],
    one of each segment that is so long, the longest first."""

    first: np.ndarray
    decision: np.ndarray
    across: np.ndarray


class Pieces(NamedTuple):
    """The tokens of texts with the decisions before each in its text, and the texts' segments:
    text i has the segments base[i]:base[i + 1], of `size` decisions each."""

    tokens: np.ndarray
    text: np.ndarray
    before: np.ndarray
    base: np.ndarray
    size: np.ndarray


def cut_texts(words: Words, tokens: np.ndarray, at: np.ndarray, segment: int) -> Pieces:
    n = np.diff(words.first)[tokens]
    total = np.concatenate(([0], np.cumsum(n)))
    text, decisions = np.repeat(np.arange(len(at) - 1), np.diff(at)), np.diff(total[at])
    base = np.concatenate(([0], np.cumsum(-(-decisions // segment))))
    size = np.full(base[-1], segment)
    size[base[1:] - 1] = decisions - (np.diff(base) - 1) * segment
    return Pieces(tokens, text, total[:-1] - total[at[text]], base, size)


def _in_time(words: Words, tail: np.ndarray, slots: np.ndarray, x: Pieces, low: int, high: int, segment: int) -> tuple[np.ndarray, Lanes]:
    """The order of the segments low to high by falling size, and their decisions."""
    shift = np.uint64(64 - (len(slots).bit_length() - 1))
    order = np.argsort(-x.size[low:high], kind="stable")
    rank, size = np.empty(high - low, np.int64), x.size[low:high][order]
    rank[order] = np.arange(high - low)
    first = np.concatenate(([0], np.cumsum(np.searchsorted(-size, -np.arange(size[0])))))
    decision, across = np.empty(first[-1], np.int32), np.zeros(first[-1], np.int16)
    per = np.diff(words.first)
    # tokens with a decision in these segments
    begins = x.base[x.text] + x.before // segment
    ends = x.base[x.text] + (x.before + per[x.tokens] - 1) // segment
    places = np.arange(np.searchsorted(ends, low), np.searchsorted(begins, high))
    for i in range(0, len(places), 1 << 15):
        own = places[i : i + (1 << 15)]
        now, n = x.tokens[own], per[x.tokens[own]]
        at = _repeated(words.first[now], n)
        k = _repeated(x.before[own], n)
        piece = np.repeat(x.base[x.text[own]], n) + k // segment
        joint = np.flatnonzero(words.place[at] < ACROSS)
        value = np.zeros(len(at), np.int16)
        value[joint] = slots[((words.whole[at[joint]] + np.repeat(tail[x.tokens[own - 1]], n)[joint]) >> shift).astype(np.int64)] >> 3
        if piece[0] < low or piece[-1] >= high:
            inside = (piece >= low) & (piece < high)
            at, k, piece, value = at[inside], k[inside], piece[inside], value[inside]
        to = first[k % segment] + rank[piece - low]
        decision[to], across[to] = at, value
    return order + low, Lanes(first, decision, across)


def mixed_bits(words: Words, tail: np.ndarray, slots: np.ndarray, tokens: np.ndarray, at: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """log2 of the probability of each text; text i has tokens[at[i]:at[i + 1]], the last its end.

    `tail` has the hashes of the ends of the words. Before a text stands the end of another.
    """
    shift = np.uint64(64 - (len(slots).bit_length() - 1))
    four, whole = slots[(words.four >> shift).astype(np.int64)], slots[(words.whole >> shift).astype(np.int64)]
    logits = np.stack(((four >> 3) * SCALE, (whole >> 3) * SCALE), 1).view(np.int64).ravel()  # both in one number
    gate = np.minimum(words.place, ACROSS) * 4 + _CLASS[whole & 7]
    online = (words.whole & np.uint64((1 << ONLINE_SLOTS) - 1)).astype(np.int32)
    meta = words.bit | (gate << 1 | online << 8).astype(np.int32)
    x = cut_texts(words, tokens, at, segment)
    out = np.zeros(len(x.size))
    for i in range(0, len(out), LANES):
        order, lanes = _in_time(words, tail, slots, x, i, min(i + LANES, len(out)), segment)
        out[order] = _mixed(lanes, logits, meta)
    return np.bincount(np.repeat(np.arange(len(at) - 1), np.diff(x.base)), out, len(at) - 1)


def _mixed(lanes: Lanes, logits: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """log2 of the probability of each lane, all of them side by side."""
    counts = np.diff(lanes.first).tolist()
    width = counts[0] if counts else 0
    # a weight for each gate and lane
    sets = np.concatenate([FIRST[0]] * ACROSS + [FIRST[1]])
    w0, w1, w2, w3 = (np.repeat(sets[:, k], width) for k in range(4))
    refined = np.tile((1 / (1 + np.exp(-np.linspace(-8, 8, CELLS)))).astype(np.float32), 4 * width)
    online = np.full(width << ONLINE_SLOTS, 0.5, np.float32)
    all_lanes = np.arange(width, dtype=np.int32)
    total, product = np.zeros(width), np.ones(width)
    begin, eps, one, half = 0, np.float32(1 / 4096), np.float32(1), np.float32(16.5)
    for step, m in enumerate(counts):
        now, x3 = lanes.decision[begin : begin + m], lanes.across[begin : begin + m] * SCALE
        begin += m
        number = all_lanes[:m]
        both, info = logits.take(now).view(np.float32), meta.take(now)
        x0, x1, bit, gate = both[::2], both[1::2], (info & 1).astype(np.float32), (info >> 1) & 127
        # the online predictor
        cell = (number << ONLINE_SLOTS) + (info >> 8)
        p = online.take(cell)
        x2 = _LOGITS.take((p * np.float32(4095)).astype(np.int32))
        online[cell] = p + (bit - p) * ONLINE_RATE
        # the gated mixer
        row = gate * width + number
        v0, v1, v2, v3 = w0.take(row), w1.take(row), w2.take(row), w3.take(row)
        dot = v0 * x0 + v1 * x1 + v2 * x2 + v3 * x3
        p = one / (one + np.exp(-dot))
        g = (bit - p) * MIXER_RATE
        w0[row], w1[row], w2[row], w3[row] = v0 + g * x0, v1 + g * x1, v2 + g * x2, v3 + g * x3
        # the refinement
        cell = ((gate & 3) * width + number) * CELLS + (np.minimum(np.maximum(dot, -8), 8) * 2 + half).astype(np.int32)
        r = refined.take(cell)
        refined[cell] = r + (bit - r) * REFINE_RATE
        p += (r - p) * PART
        product[:m] *= np.minimum(np.maximum(np.abs(one - bit - p), eps), one - eps)
        if step % 64 == 63:  # 4096 ** -64 is a double
            total += np.log2(product)
            product[:] = 1
    return total + np.log2(product)


def score_texts(x: Texts, model: Model, segment: int = SEGMENT) -> np.ndarray:
    """log2 of the model's probability of each text."""
    return mixed_bits(spell(x.words, model.codes), tail_hashes(x.words), model.slots, x.tokens, x.at, segment)


def score_documents(docs: DataFrame, fold: int = 1, folds: int = 5, segment: int = SEGMENT, most_slots: int = MOST_SLOTS) -> DataFrame:
    """One row a document with its base score and the model's; see the module for the model.

    Rows whose crc32(doc_id as text) mod `folds` is `fold` are held out, all others train.
    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))
    stored = written(docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(_blocks, f"block long, doc_id array<{kind}>, held_out array<boolean>, size array<long>, n array<long>, tokens binary, n_words long, words binary, counts binary, joint array<long>, joint_n array<long>"))
    n_words = stored.agg(F.sum("n_words")).first()[0] or 0
    bits = max(4, (n_words // BUCKET).bit_length())
    pieces = stored.select("block", "words", "counts").mapInArrow(_divided(bits), "bucket long, block long, first long, words binary, counts binary")
    counted = written(pieces.groupBy("bucket").applyInArrow(_counted, "block long, first long, words binary, counts binary"))
    pairs = stored.select(F.explode(F.arrays_zip("joint", "joint_n")).alias("x")).groupBy("x.joint").agg(F.sum("x.joint_n").alias("n"))
    model = spark.sparkContext.broadcast(train(counted.where("block is null"), cut(pairs), most_slots))

    def score(blocks: pa.Table, known: pa.Table) -> pa.Table:
        m, row = model.value, blocks.slice(0, 1)
        known = known.sort_by("first")
        words = flat(b"".join(zstandard.decompress(w) for w in known.column("words").to_pylist()))
        c = np.concatenate([_unpack(x, np.int64) for x in known.column("counts").to_pylist()])
        column = lambda name: row.column(name).combine_chunks().flatten()
        n, size = column("n").to_numpy(), column("size").to_numpy()
        x = Texts(words, _unpack(row.column("tokens")[0].as_py(), np.uint32).astype(np.int64), np.concatenate(([0], np.cumsum(n))))
        bits, of = score_texts(x, m, segment), np.repeat(np.arange(len(n)), n)
        by_word = np.log10((c + 0.5) / (m.n + 0.5 * (m.v + 1)))
        longs = {"n_tokens": n, "n_known": np.bincount(of, (c > 0)[x.tokens], len(n)).astype(np.int64), "train_tokens": np.full(len(n), m.n)}
        per_byte = pa.array(-bits / np.maximum(size, 1), pa.float64(), mask=size == 0)
        return pa.table({"doc_id": column("doc_id"), "held_out": column("held_out"), **longs, "base_score": np.bincount(of, by_word[x.tokens], len(n)), "score": bits * np.log10(2.0), "bits_per_byte": per_byte})

    texts = stored.select("block", "doc_id", "held_out", "size", "n", "tokens")
    answers = counted.where("block is not null")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def op12_lm_scores(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op12_lm_scores": op12_lm_scores}
