"""Suffix-array dedup by a common-prefix-aware merge sort (operator 5).

Every byte covered by a string of `length` bytes that also starts elsewhere is
removed. Only suffixes that can matter are sorted, and no repeat is lost:

1. Each window of `length` bytes has an anchor, its smallest block of `block`
   bytes by hash. Equal windows have equal anchors at equal places. Anchors are
   counted over all documents; those that occur once are dropped.
2. Neighbouring windows share an anchor, so one suffix from the anchor, cut at
   the last of these windows, stands for all of them; what precedes the anchor
   follows it, reversed. Each task sorts the suffixes of its documents, front
   codes them (the length of the prefix shared with the one before, and the
   rest) and exchanges these runs by anchor. Suffixes that a task has more than
   once are settled there and sent once, without their places; the spans of
   these places are merged by document and exchanged apart from all runs.
3. A loser tree merges the runs of an anchor range. Each string carries the
   length of its common prefix with the last output, so known prefixes are never
   compared again; the merge also yields the common prefix of neighbours.
4. Suffixes of one anchor that are equal repeat as a whole. For different ones,
   the common bytes right of the anchor (from the merge) and left of it decide.

Anchors with more than `hot` places could fill a task, so a second method takes
them: their windows leave the merge sort and are sent one by one under two 64-bit
hashes of different seeds, spread by them, after each task has combined equal
ones; no group grows with the number of its copies. There, equal hashes stand for
equal bytes; the hashes mix halves without sums, so special texts don't collide.

Defined cases: a null text counts as empty; texts shorter than `length` lose
nothing; repeated rows are documents of their own that repeat each other; ties
between anchors go to the leftmost; removal may cut within a character, as bytes
are judged; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import marshal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import _text
from weftline.llm._graph import cut, table

LENGTH, BLOCK = 200, 96
#: Places of an anchor beyond which its windows are spread one by one.
HOT = 10_000
#: Bytes of suffixes that a task sorts at once, and suffixes of an average exchange group.
RUN_BYTES, GROUP = 24 << 20, 8192
#: Window starts that are handled at once in a long text.
STARTS = 1 << 20
_POSITION = np.uint64((1 << 22) - 1)
SEPARATOR = b"\xff"  # in no UTF-8 text


def _block_hashes(data: np.ndarray, size: int, base: int = 0) -> np.ndarray:
    n = len(data) - size + 1
    at = np.arange(max(n, 0))
    return _text.rolling_hashes(data ^ np.uint8(base), at, at + size) if n > 0 else np.zeros(0, np.uint64)


def anchor_runs(data: np.ndarray, at: np.ndarray, length: int = LENGTH, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For parts of a batch: row, first and last window start, anchor place, anchor hash.

    Places count from the start of the batch's bytes. Each run is a maximal set
    of neighbouring windows of one text with the same anchor.
    """
    for low in range(0, len(data), STARTS):
        part = data[low : low + STARTS + length - 1]
        n = len(part) - length + 1
        if n <= 0:
            continue
        hashes = _block_hashes(part, block)
        best = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
        width, want = 1, length - block + 1
        while width < want:
            step = min(width, want - width)
            best = np.minimum(best[:-step], best[step:])
            width += step
        anchor = (best[:n] & _POSITION).astype(np.int64)
        row = np.searchsorted(at, low + np.arange(n), "right") - 1
        inside = low + np.arange(n) + length <= at[np.minimum(row + 1, len(at) - 1)]
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new & inside)
        if not len(first):
            continue
        # a run ends before the next run starts, or at the last window of its text
        starts = np.flatnonzero(new)
        following = np.append(starts[1:], n)[np.searchsorted(starts, first)]
        last = np.minimum(following - 1, at[row[first] + 1] - length - low)
        yield row[first], first + low, last + low, anchor[first] + low, hashes[anchor[first]]


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that share `known` bytes."""
    end = min(len(a), len(b))
    if a[known:end] == b[known:end]:
        return end
    low, high = known, end
    while high - low > 1:
        half = (low + high) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half
    return low


class LoserTree:
    """Merges sorted runs of (lcp with the string before, string, payload).

    Every waiting string knows its common prefix with the last output. A longer
    one is the smaller string, without a look at the bytes; only equal lengths
    are compared, from there on.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]):
        self.runs = runs
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.losers: list = [None] * self.size
        self.top = self._build(1)

    def _next(self, run: int):
        item = next(self.runs[run], None) if run < len(self.runs) else None
        return None if item is None else [item[0], item[1], item[2], run]

    def _build(self, node: int):
        if node >= self.size:
            first = self._next(node - self.size)
            if first is not None:
                first[0] = 0
            return first
        a, b = self._build(2 * node), self._build(2 * node + 1)
        winner, self.losers[node] = self._play(a, b)
        return winner

    @staticmethod
    def _play(a, b):
        """(winner, loser); the loser's length becomes that with the winner."""
        if a is None or b is None:
            return (b, a) if a is None else (a, b)
        if a[0] != b[0]:
            return (a, b) if a[0] > b[0] else (b, a)
        shared = common(a[1], b[1], a[0])
        if shared == len(a[1]) or (shared < len(b[1]) and a[1][shared] < b[1][shared]):
            b[0] = shared
            return a, b
        a[0] = shared
        return b, a

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        while self.top is not None:
            lcp, text, payload, run = self.top
            yield lcp, text, payload
            now = self._next(run)
            node = (self.size + run) // 2
            while node:
                now, self.losers[node] = self._play(now, self.losers[node])
                node //= 2
            self.top = now


def front_code(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Shared lengths, rest lengths (two bytes each) and rests of sorted strings."""
    shared, rests, before = [], [], b""
    for s in strings:
        k = common(before, s)
        shared.append(k)
        rests.append(s[k:])
        before = s
    return np.array(shared, np.uint16).tobytes(), np.array([len(r) for r in rests], np.uint16).tobytes(), b"".join(rests)


def front_decode(shared: bytes, sizes: bytes, rests: bytes) -> Iterator[tuple[int, bytes]]:
    before, at = b"", 0
    for k, n in zip(np.frombuffer(shared, np.uint16).tolist(), np.frombuffer(sizes, np.uint16).tolist(), strict=True):
        before = before[:k] + rests[at : at + n]
        at += n
        yield k, before


def merged(spans: np.ndarray) -> np.ndarray:
    """The rows (k1, k2, start, end), sorted, with overlapping spans of a document as one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    doc = np.zeros(len(spans), bool)
    doc[1:] = (spans[1:, :2] != spans[:-1, :2]).any(1)
    # the furthest end so far in the document: ends are lifted by document to be one running maximum
    lift = np.cumsum(doc) * (int(spans[:, 3].max()) + 1)
    reach = np.maximum.accumulate(spans[:, 3] + lift)
    new = doc.copy()
    new[0] = True
    new[1:] |= spans[1:, 2] + lift[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return np.column_stack((spans[at, :3], np.maximum.reduceat(spans[:, 3], at)))


class _Runs:
    """Collects the suffixes of a task and turns them into rows to exchange."""

    def __init__(self, buckets: int, task: int = 0):
        self.buckets, self.items, self.bytes = buckets, [], 0
        self.windows: list[np.ndarray] = []
        self.task, self.flushes = task, 0

    def _settled(self, spans: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(bucket, spans): the settled spans, merged by document, in buckets below 0.

        Buckets hang on the document and the flush: spans of a document meet again
        in the last aggregate only, and neither copies nor equal rows share a bucket.
        """
        spans = merged(spans)
        if not len(spans):
            return
        salt = _text.mix(np.array([self.task << 32 | self.flushes], np.uint64))
        to = _text.mix(spans[:, 0].view(np.uint64) ^ _text.mix(spans[:, 1].view(np.uint64)) ^ salt) % np.uint64(self.buckets)
        order = np.argsort(to, kind="stable")
        edges = np.flatnonzero(np.diff(to[order], prepend=to[order][:1] + np.uint64(1)))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(spans)], strict=True):
            yield -1 - int(to[order[a]]), spans[order[a:b]].tobytes()

    def rows(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, blob): front-coded runs and windows, and apart from them settled spans."""
        settled: list[np.ndarray] = []
        self.items.sort(key=lambda x: x[:2])
        items, n, i = self.items, len(self.items), 0
        pack = zstandard.ZstdCompressor(level=1)
        per: dict[int, list] = {}
        while i < n:
            bucket = items[i][0]
            strings, refs, spans = [], [], []
            while i < n and items[i][0] == bucket:
                j = i + 1
                while j < n and items[j][0] == bucket and items[j][1] == items[i][1]:
                    j += 1
                z = items[i][1]
                if j == i + 1:
                    refs.append(items[i][2])
                else:  # settled here: all windows of these places repeat
                    right = z.index(SEPARATOR)
                    spans += [(k1, k2, p - (len(z) - right - 1), p + right) for _, _, (k1, k2, p) in items[i:j]]
                    refs.append((0, 0, -1))
                strings.append(z)
                i = j
            settled.append(np.array(spans, np.int64).reshape(-1, 4))
            per[bucket] = [*front_code(strings), np.array(refs, np.int64).tobytes(), b""]
        if self.windows:
            w = np.concatenate(self.windows)
            w = w[np.lexsort((w[:, 1], w[:, 0]))]
            same = np.zeros(len(w), bool)
            same[1:] = (w[1:, :2] == w[:-1, :2]).all(1)
            several = same.copy()
            several[:-1] |= same[1:]
            settled.append(w[several, 2:])
            w = w[~same]
            w[several[~same], 4] = -1
            to = (w[:, 0].view(np.uint64) >> np.uint64(7)) % np.uint64(self.buckets)
            order = np.argsort(to, kind="stable")
            edges = np.flatnonzero(np.diff(to[order], prepend=to[order][:1] + np.uint64(1)))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(w)], strict=True):
                per.setdefault(int(to[order[a]]), [b""] * 5)[4] = w[order[a:b]].tobytes()
        self.items, self.windows, self.bytes = [], [], 0
        for bucket, parts in per.items():
            yield bucket, pack.compress(marshal.dumps(tuple(parts)))
        if settled:
            for bucket, spans in self._settled(np.concatenate(settled)):
                yield bucket, pack.compress(spans)
        self.flushes += 1


def _settle(group: list[list], length: int, block: int, out: list) -> None:
    """Spans that repeat among the different suffixes of one anchor.

    `group` holds [right, left reversed, number of places, refs, lcp with the one
    before], in sorted order.
    """
    m = len(group)
    best = [[-1, -1] for _ in group]
    for i, (right, left, places, _, _) in enumerate(group):
        if places > 1:
            best[i] = [len(left), len(right)]
    if 1 < m <= 24:
        for i in range(m):
            shared = 1 << 30
            for j in range(i + 1, m):
                shared = min(shared, group[j][4])
                r = min(shared, len(group[i][0]), len(group[j][0]))
                le = common(group[i][1], group[j][1])
                if r + le >= length:
                    for b in (best[i], best[j]):
                        b[0], b[1] = max(b[0], le), max(b[1], r)
    elif m > 1:
        seen: dict[bytes, list] = {}
        for i, (right, left, places, _, _) in enumerate(group):
            whole, k = left[::-1] + right, len(left)
            for d in range(max(0, length - len(right)), k + 1):
                w = whole[k - d : k - d + length]
                e = seen.setdefault(w, [0, [], d])
                e[0] += places
                e[1].append(i)
        for places, who, d in seen.values():
            if places > 1:
                for i in who:
                    best[i][0], best[i][1] = max(best[i][0], d), max(best[i][1], length - d)
    for (_, _, _, refs, _), (le, r) in zip(group, best, strict=True):
        if r >= 0:
            out += [(k1, k2, p - le, p + r) for k1, k2, p in refs if p >= 0]


def _merge(blobs: list[bytes], length: int, block: int) -> np.ndarray:
    """Repeated spans (k1, k2, start, end) of one exchange group."""
    unpack = zstandard.ZstdDecompressor()
    parts = [marshal.loads(unpack.decompress(b)) for b in blobs]
    done: list[np.ndarray] = []

    def run(p) -> Iterator[tuple[int, bytes, tuple]]:
        refs = np.frombuffer(p[3], np.int64).reshape(-1, 3).tolist()
        for (k, z), ref in zip(front_decode(*p[:3]), refs, strict=True):
            yield k, z, tuple(ref)

    out: list[tuple] = []
    group: list[list] = []
    for lcp, z, ref in LoserTree([run(p) for p in parts if p[0]]):
        places = 2 if ref[2] < 0 else 1  # settled ones had several
        if group and lcp < block:
            _settle(group, length, block, out)
            group = []
        right = z.index(SEPARATOR)
        if group and lcp == len(z) == len(group[-1][0]) + 1 + len(group[-1][1]):
            group[-1][2] += places
            group[-1][3].append(ref)
        else:
            group.append([z[:right], z[right + 1 :], places, [ref], lcp])
    if group:
        _settle(group, length, block, out)
    windows = [np.frombuffer(p[4], np.int64).reshape(-1, 6) for p in parts]
    w = np.concatenate(windows)
    if len(w):
        w = w[np.lexsort((w[:, 1], w[:, 0]))]
        same = np.zeros(len(w) + 1, bool)
        same[1:-1] = (w[1:, :2] == w[:-1, :2]).all(1)
        start = np.flatnonzero(~same[:-1])
        size = np.diff(np.append(start, len(w)))
        many = np.repeat(size > 1, size)
        hit = w[many & (w[:, 4] >= 0)]
        done.append(hit[:, 2:])
    return np.concatenate([*done, np.array(out, np.int64).reshape(-1, 4)])


def repeated_spans(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(k1, k2, spans): repeated byte spans of each document that has any.

    k1 and k2 are hashes of doc_id and text; equal rows share their spans.
    """
    keyed = docs.select(F.xxhash64("doc_id").alias("k1"), F.xxhash64("text").alias("k2"), "text")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in _text.groups(batches):
            for row, _, _, _, h in anchor_runs(data, at, length, block):
                edges = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.record_batch({"k1": batch.column("k1"), "k2": batch.column("k2"), "anchors": pa.ListArray.from_arrays(pa.array(edges), pa.array(h.view(np.int64)))})

    found = cut(keyed.mapInArrow(anchors, "k1 long, k2 long, anchors array<long>").where(F.size("anchors") > 0))
    places = found.select("k1", "k2", F.explode("anchors").alias("h"))
    # cut, so that the join gets an exchange of its own and hot anchors can be split
    shared = cut(places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    needed = cut(places.join(shared, "h").groupBy("k1", "k2").agg(F.collect_set("h").alias("shared"), F.collect_set(F.when(F.col("n") > hot, F.col("h"))).alias("hot"), F.count("*").alias("m")))
    buckets = max(64, (needed.agg(F.sum("m")).first()[0] or 0) // GROUP)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Runs(buckets, TaskContext.get().partitionId())
        for batch, data, at in _text.groups(batches):
            raw = data.tobytes()
            k1, k2 = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
            want = np.unique(batch.column("shared").flatten().to_numpy()).view(np.uint64)
            loud = np.unique(batch.column("hot").flatten().to_numpy()).view(np.uint64)
            for row, first, last, place, h in anchor_runs(data, at, length, block):
                keep = np.isin(h, want)
                burst = keep & np.isin(h, loud)
                keep &= ~burst
                for r, a, b, p, bucket in zip(row[keep].tolist(), first[keep].tolist(), last[keep].tolist(), place[keep].tolist(), (h[keep] % np.uint64(buckets)).tolist(), strict=True):
                    z = raw[p : b + length] + SEPARATOR + raw[a:p][::-1]
                    held.items.append((bucket, z, (k1[r], k2[r], p - int(at[r]))))
                    held.bytes += len(z) + 200
                if burst.any():
                    size = (last - first + 1)[burst]
                    starts = np.repeat(first[burst], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    rows_ = np.repeat(row[burst], size)
                    lo, hi = int(starts[0]), int(starts[-1]) + length
                    w = [_text.window_hashes(data[lo:hi], length, seed)[starts - lo].view(np.int64) for seed in (1, 2)]
                    begin = starts - at[rows_]
                    held.windows.append(np.column_stack((*w, np.array(k1, np.int64)[rows_], np.array(k2, np.int64)[rows_], begin, begin + length)))
                    held.bytes += 48 * len(starts)
                if held.bytes > RUN_BYTES:
                    yield from packed(held)
        yield from packed(held)

    def packed(held: _Runs) -> Iterator[pa.RecordBatch]:
        rows = list(held.rows())
        for i in range(0, len(rows), 1000):
            yield pa.record_batch({"bucket": pa.array([b for b, _ in rows[i : i + 1000]], pa.int64()), "run": pa.array([r for _, r in rows[i : i + 1000]], pa.binary())})

    def merge(group: pa.Table) -> pa.Table:
        blobs = group.column("run").to_pylist()
        if group.column("bucket")[0].as_py() < 0:
            unpack = zstandard.ZstdDecompressor()
            spans = np.concatenate([np.frombuffer(unpack.decompress(b), np.int64) for b in blobs]).reshape(-1, 4)
        else:
            spans = _merge(blobs, length, block)
        spans = merged(spans)
        return pa.table({"k1": spans[:, 0], "k2": spans[:, 1], "s": spans[:, 2], "e": spans[:, 3]})

    exchanged = keyed.join(needed.select("k1", "k2", "shared", "hot"), ["k1", "k2"]).mapInArrow(runs, "bucket long, run binary")
    spans = exchanged.groupBy("bucket").applyInArrow(merge, "k1 long, k2 long, s long, e long")
    return cut(spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e")).alias("spans")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(doc_id, kept, n_bytes, spans): what is left of each text, as bytes."""
    spans = repeated_spans(docs, length, block, hot)
    keyed = docs.select("doc_id", F.xxhash64("doc_id").alias("k1"), F.xxhash64("text").alias("k2"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in _text.groups(batches):
            raw, kept, runs = data.tobytes(), [], []
            for i, found in enumerate(batch.column("spans").to_pylist()):
                text = raw[at[i] : at[i + 1]]
                merged: list[list[int]] = []
                for x in sorted((x["s"], x["e"]) for x in found or []):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(list(x))
                edges = [0, *[v for m in merged for v in m], len(text)]
                kept.append(b"".join(text[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2)))
                runs.append([{"s": a, "e": b} for a, b in merged])
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "kept": pa.array(kept, pa.binary()), "n_bytes": np.diff(at), "spans": pa.array(runs, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))})

    return keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(strip, f"doc_id {id_type}, kept binary, n_bytes long, spans array<struct<s:bigint,e:bigint>>")



def op5_suffixes(spark, sf_dir):
    done = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.length("kept")
    return done.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op5_suffixes": op5_suffixes}
