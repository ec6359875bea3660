"""Quality rules by line sequence labelling (operator 6).

A linear-chain conditional random field labels every line of a text as content
or boilerplate. Lines are described by a few discrete features (length, share
of symbols, digits and capitals, repeated words and lines, frames of tables);
Viterbi decoding finds the best label sequence, and a document is retained if
the share of its words that stand in content lines reaches a threshold. A base
rule that counts words decides first.

The field is fitted by maximum likelihood on a bounded sample of labelled
documents (`TRAINING_DOCUMENTS`, chosen by a hash of the id, with at most
`TRAINING_LINES` neighbouring lines of each, from a place that a hash chooses): lines
of good documents are content; of bad ones, those are boilerplate whose features
occur mostly in bad documents. There are no labels of lines, so these are a guess; a
test measures the documents' verdicts on held-out labels. Without both classes the
prior weights are kept.

Lines and windows count as equal by 64-bit hashes of all their bytes, within a text.

Defined cases: a null, empty or blank text has 0 words and fails the base rule;
each row is judged alone, so repeated rows and extra columns need no care; an
empty table gives an empty table; labels with nulls are left out of the fit, and of
rows that share a doc_id one is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import _text
from weftline.llm._graph import table

#: Bounds of the sample that the field is fitted on: documents, and lines of each.
TRAINING_DOCUMENTS, TRAINING_LINES = 2000, 256
#: Chains of more lines are decoded one by one.
LANE_LINES = 256
#: Share of a document's words in content lines that retains it.
CONTENT_SHARE = 0.5
SYMBOLS = "#*$%&|<>"
#: Values of each feature of a line.
FEATURES = {"words": 5, "symbols": 4, "digits": 3, "capitals": 4, "echo": 4, "copy": 2, "frame": 3, "loud": 3}
OFFSETS = np.concatenate(([0], np.cumsum(list(FEATURES.values()))))
N_FEATURES = int(OFFSETS[-1])

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b"#*$%&<>@=~^_{}[]\\")] = 1
_CLASS[list(b"0123456789")] = 2
_CLASS[list(range(65, 91))] = 3
_CLASS[list(b"|")] = 4
_CLASS[list(b"!?")] = 5


class Lines:
    """Whole texts of a batch as words and lines, and the base counts."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        n = len(at) - 1
        starts, ends, of = _text.words(data, at)
        hashes = _text.span_hashes(data, starts, ends)
        self.n_words = np.diff(of)
        heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
        letters = np.concatenate(([0], np.cumsum(heads[ends] - heads[starts])))
        self.word_chars = np.diff(letters[of])
        symbols = np.isin(data, np.frombuffer(SYMBOLS.encode(), np.uint8))
        self.n_symbols = np.diff(np.concatenate(([0], np.cumsum(symbols)))[at])
        # a word belongs to a repeated window if one of the windows over it is not unique in its text
        doc = np.repeat(np.arange(n), self.n_words)
        repeated = np.zeros(len(starts), bool)
        if len(starts) >= 3:
            same = doc[2:] == doc[:-2]
            k = np.uint64(0x9E3779B97F4A7C15)
            windows = _text.mix(((hashes[:-2] * k + hashes[1:-1]) * k + hashes[2:]) * k + doc[2:].astype(np.uint64))
            where = np.flatnonzero(same)
            _, inverse, counts = np.unique(windows[where], return_inverse=True, return_counts=True)
            hit = where[counts[inverse] > 1]
            for k in range(3):
                repeated[hit + k] = True
        self.n_repeat_words = np.diff(np.concatenate(([0], np.cumsum(repeated)))[of])
        # lines: cut at every \n and at the ends of texts
        breaks = np.flatnonzero(data == 10)
        per = np.diff(np.searchsorted(breaks, at))
        self.line_at = np.concatenate(([0], np.cumsum(per + 1)))
        first, last = np.empty(self.line_at[-1], np.int64), np.empty(self.line_at[-1], np.int64)
        inner = np.ones(len(first), bool)
        inner[self.line_at[:-1]] = False
        first[self.line_at[:-1]], first[inner] = at[:-1], breaks + 1
        inner[:] = True
        inner[self.line_at[1:] - 1] = False
        last[self.line_at[1:] - 1], last[inner] = at[1:], breaks
        self.line_words = np.searchsorted(starts, last) - np.searchsorted(starts, first)
        line_doc = np.repeat(np.arange(n), per + 1)
        key = _text.mix(_text.span_hashes(data, first, last) + line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        key[self.line_words == 0] = np.uint64(0)
        filled = np.flatnonzero(self.line_words)
        _, once = np.unique(key[filled], return_index=True)
        copy = np.zeros(len(first), bool)
        copy[filled] = True
        copy[filled[once]] = False
        self.n_dup_lines = np.diff(np.concatenate(([0], np.cumsum(copy)))[self.line_at])
        self.features = self._features(data, first, last, starts, hashes, copy)

    def _features(self, data, first, last, starts, hashes, copy) -> np.ndarray:
        kind = _CLASS[data]
        size = np.maximum(last - first, 1)
        share = lambda *k: (lambda c: (c[last] - c[first]) / size)(np.concatenate(([0], np.cumsum(np.isin(kind, k)))))
        count = lambda *k: (lambda c: c[last] - c[first])(np.concatenate(([0], np.cumsum(np.isin(kind, k)))))
        echo = np.zeros(len(starts) + 1, np.int64)
        if len(starts) > 1:
            echo[2:] = np.cumsum(hashes[1:] == hashes[:-1])
        lo, hi = np.searchsorted(starts, first), np.searchsorted(starts, last)
        echoes = np.where(hi > lo, echo[hi] - echo[np.minimum(lo + 1, hi)], 0) / np.maximum(hi - lo, 1)
        columns = [
            np.digitize(self.line_words, [1, 3, 8, 20]),
            np.digitize(share(1), [0.005, 0.03, 0.1]),
            np.digitize(share(2), [0.05, 0.25]),
            np.digitize(share(3), [0.06, 0.2, 0.5]),
            np.digitize(echoes, [0.02, 0.15, 0.4]),
            copy.astype(np.int64),
            np.digitize(count(4), [1, 4]),
            np.digitize(count(5) / np.maximum(hi - lo, 1), [0.1, 0.5]),
        ]
        return np.stack(columns, 1) + OFFSETS[:-1]


class Field:
    """Weights of a two-label chain: label 0 is content, 1 is boilerplate."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros((N_FEATURES, 2)) if emit is None else emit
        self.move = np.array([[1.0, -1.0], [-1.0, 1.0]]) if move is None else move
        if emit is None:  # prior weights: symbols, echoes, shouting and copies speak for boilerplate
            at = dict(zip(FEATURES, OFFSETS, strict=False))
            self.emit[:, 0] = 0.15
            for name, value, weight in (("symbols", 2, 2), ("symbols", 3, 3), ("capitals", 3, 2), ("echo", 2, 2), ("echo", 3, 3), ("copy", 1, 2), ("loud", 2, 2)):
                self.emit[at[name] + value, 1] = weight

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.emit[features].sum(1)

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """The best labels of one sequence."""
        (m00, m01), (m10, m11) = self.move.tolist()
        back, (a, b) = [], scores[0].tolist()
        for x, y in scores[1:].tolist():
            from0, from1 = a + m00 < b + m10, a + m01 < b + m11
            a, b = (b + m10 if from0 else a + m00) + x, (b + m11 if from1 else a + m01) + y
            back.append((from0, from1))
        labels = [int(b > a)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return np.array(labels[::-1])

    def decode(self, scores: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The best labels of the sequences scores[at[i]:at[i + 1]], all by line number."""
        size = np.diff(at)
        labels = np.empty(len(scores), np.int64)
        for i in np.flatnonzero(size > LANE_LINES).tolist():
            labels[at[i] : at[i + 1]] = self.viterbi(scores[at[i] : at[i + 1]])
        order = np.flatnonzero((size > 0) & (size <= LANE_LINES))
        order = order[np.argsort(-size[order], kind="stable")]
        if not len(order):
            return labels
        first, falling = at[:-1][order], -size[order]
        live = [int(np.searchsorted(falling, -t, "left")) for t in range(int(size[order[0]]))]  # longer than t lines
        best, back = scores[first], []
        for t in range(1, len(live)):
            come = best[: live[t], :, None] + self.move  # from label by to label
            back.append(come[:, 1] > come[:, 0])
            best[: live[t]] = come.max(1) + scores[first[: live[t]] + t]
        label = (best[:, 1] > best[:, 0]).astype(np.int64)
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            labels[first[:n] + t] = label[:n]
            if t:
                label[:n] = back[t - 1][np.arange(n), label[:n]]
        return labels

    def gradient(self, feats: np.ndarray, gold: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The derivative of the log likelihood of (chains, lines) by emit and move."""
        n, length = gold.shape
        pairs = mask[:, 1:]
        onehot = np.eye(2)[gold] * mask[..., None]
        want_emit = self._spread(feats, onehot)
        want_move = np.einsum("nta,ntb->ab", onehot[:, :-1], onehot[:, 1:] * pairs[..., None])
        s = self.emit[feats].sum(2)
        ahead = np.zeros((n, length, 2))
        behind = np.zeros((n, length, 2))
        ahead[:, 0] = s[:, 0]
        for t in range(1, length):
            step = np.logaddexp(ahead[:, t - 1, :1] + self.move[0], ahead[:, t - 1, 1:] + self.move[1]) + s[:, t]
            ahead[:, t] = np.where(mask[:, t, None], step, ahead[:, t - 1])
        for t in range(length - 2, -1, -1):
            after = s[:, t + 1] + behind[:, t + 1]
            step = np.logaddexp(self.move[:, 0] + after[:, :1], self.move[:, 1] + after[:, 1:])
            behind[:, t] = np.where(mask[:, t + 1, None], step, 0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])[:, None, None]
        p = np.exp(ahead + behind - total) * mask[..., None]
        q = np.exp(ahead[:, :-1, :, None] + self.move + (s + behind)[:, 1:, None, :] - total[..., None]) * pairs[..., None, None]
        return want_emit - self._spread(feats, p), want_move - q.sum((0, 1))

    def fit(self, chains: list[tuple[np.ndarray, np.ndarray]], length: int = 32, rounds: int = 150, rate: float = 2.0, decay: float = 1e-3) -> Field:
        """Maximise the likelihood of (features, labels); chains are cut to `length` lines."""
        pieces = [(f[i : i + length], y[i : i + length]) for f, y in chains for i in range(0, len(f), length)]
        groups, low = [], 0
        for high in (length // 8, length // 4, length // 2, length):  # little padding
            part = [(f, y) for f, y in pieces if low < len(f) <= high]
            low = high
            feats, gold, mask = np.zeros((len(part), high, len(FEATURES)), np.int64), np.zeros((len(part), high), np.int64), np.zeros((len(part), high), bool)
            for i, (f, y) in enumerate(part):
                feats[i, : len(f)], gold[i, : len(f)], mask[i, : len(f)] = f, y, True
            if part:
                groups.append((feats, gold, mask))
        lines = sum(len(f) for f, _ in pieces)
        for _ in range(rounds):
            steps = [self.gradient(*g) for g in groups]
            self.emit += rate * (sum(e for e, _ in steps) / lines - decay * self.emit)
            self.move += rate * (sum(m for _, m in steps) / lines - decay * self.move)
        return self

    @staticmethod
    def _spread(feats: np.ndarray, weight: np.ndarray) -> np.ndarray:
        flat = feats.reshape(-1, feats.shape[-1])
        out = np.zeros((N_FEATURES, 2))
        for label in (0, 1):
            w = weight[..., label].reshape(-1)
            for j in range(flat.shape[1]):
                out[:, label] += np.bincount(flat[:, j], w, N_FEATURES)
        return out


def training_chains(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCUMENTS, lines: int = TRAINING_LINES) -> list[tuple[np.ndarray, int]]:
    """Line features of at most `most` labelled documents with their quality, `lines` of each.

    The sample is chosen by a hash of the id, so it is the same in every run; the
    texts stay on the executors, which send 8 small numbers a line.
    """
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.md5(F.concat(F.lit("crf:"), F.col("doc_id").cast("string"))), "doc_id").limit(most)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("quality").cast("int").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in _text.groups(batches):
            x = Lines(data, at)
            per = np.diff(x.line_at)
            ids = batch.column("doc_id").cast(pa.int64()).to_numpy().view(np.uint64)
            low = x.line_at[:-1] + (_text.mix(ids) % np.maximum(per - lines + 1, 1).astype(np.uint64)).astype(np.int64)
            packed = [x.features[a : min(a + lines, b)].astype(np.uint8).tobytes() for a, b in zip(low.tolist(), x.line_at[1:].tolist(), strict=True)]
            yield pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.string()), "quality": batch.column("quality"), "features": pa.array(packed, pa.binary())})

    rows = sample.mapInArrow(run, "doc_id string, quality int, features binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.features)))
    return [(np.frombuffer(bytes(r.features), np.uint8).reshape(-1, len(FEATURES)).astype(np.int64), r.quality) for r in rows]


def fit_field(sample: list[tuple[np.ndarray, int]]) -> Field:
    """Fit the chain on documents with a quality of 0 or 1.

    The line labels come from the documents: a line of a bad document counts as
    boilerplate if one of its feature values is at least three times as frequent
    in lines of bad documents, else as content.
    """
    good = [f for f, q in sample if q]
    bad = [f for f, q in sample if not q]
    if not good or not bad:
        return Field()
    rate = lambda fs: (np.bincount(np.concatenate(fs).reshape(-1), minlength=N_FEATURES) + 1.0) / (sum(map(len, fs)) + 2.0)
    telling = rate(bad) > 3 * rate(good)
    chains = [(f, telling[f].any(1).astype(np.int64) * (1 - q)) for f, q in sample]
    return Field().fit(chains)


def _judge(x: Lines, chain: Field, share: float) -> dict[str, np.ndarray]:
    """The verdicts on the texts of a batch."""
    content = chain.decode(chain.scores(x.features), x.line_at) == 0
    sums = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[x.line_at])
    part = sums(x.line_words * content) / np.maximum(x.n_words, 1)
    failed = (x.n_words < 50) | (100 * x.n_repeat_words > 50 * x.n_words)
    return {"base_failed": failed, "n_lines": np.diff(x.line_at), "n_content_lines": sums(content), "content_share": part, "kept": ~failed & (part >= share)}


def label_quality(docs: DataFrame, field: Field, share: float = CONTENT_SHARE) -> DataFrame:
    """doc_id, the base counts, base_failed, n_lines, n_content_lines, content_share, kept."""
    emit, move = field.emit, field.move

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Field(emit, move)
        for batch, data, at in _text.groups(batches):
            x = Lines(data, at)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": x.n_words, "word_chars": x.word_chars, "n_symbols": x.n_symbols, "n_dup_lines": x.n_dup_lines, "n_repeat_words": x.n_repeat_words, **_judge(x, chain, share)})

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_content_lines long, content_share double, kept boolean")


def keep_quality(docs: DataFrame, field: Field, share: float = CONTENT_SHARE) -> DataFrame:
    """The documents that the base rule and the field retain, with all columns."""
    emit, move = field.emit, field.move

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Field(emit, move)
        for batch, data, at in _text.groups(batches):
            yield batch.filter(pa.array(_judge(Lines(data, at), chain, share)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return label_quality(docs, fit_field(training_chains(docs, table(spark, sf_dir, "labels"))))


QUERIES = {"op6_quality": op6_quality}
