"""SentencePiece encoding and decoding by a max-plus parallel scan (operator 2).

The models are byte-pair encodings. A sequence of pieces is the encoding of a
text exactly if every two neighbours are the encoding of their joined text, so
the encoding is the one path of weight 0 through a graph whose edges weigh 0
(the pair is stable) or minus infinity. That makes it a max-plus problem:

1. A giant text is cut into chunks at fixed places, wherever they fall. The
   states at a boundary are the pieces that may cover it, found from the few
   characters on both sides. Each chunk yields its matrix of transfer weights
   from the states at its start to those at its end.
2. The matrices of a text are combined by an associative max-plus product, up
   and down; the best state at every boundary follows.
3. Each chunk is then traced back on its own between its two known states.

Pieces never go over a word start (a space after another character, or a character
that no piece joins to others), where all states meet. Only words cut by a chunk's
boundaries have several states to begin or end with; the words between have one, and
are decoded side by side, a word a lane: the one piece that ends at each place on the
path from the word's start, then the trace back from its end. Texts up to `giant`
characters are single chunks, decoded in the same way. The library only reads the
model file.

Results equal those of the library on the whole text. Defined cases: a null or
empty text has no ids and decodes to an empty text; the word-start mark in a
text decodes to a space, as in the library; characters outside the vocabulary
become byte pieces; repeated rows are encoded alike; other columns pass through, but
a column named like an added one is replaced by it; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._graph import clash, packed, table, unpacked

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk, and of the longest text that is one chunk.
CHUNK, GIANT = 1 << 14, 1 << 15
#: Characters of the longest word that shares lanes, and of the texts scanned at once.
LANE, SCANNED = 64, 1 << 18
#: Slots of the table of known pairs, as a power of two.
PAIR_BITS = 19
MARK = "▁"
IMPOSSIBLE = -np.inf


class Model:
    """A byte-pair model as a graph of pieces with stable pairs as edges."""

    def __init__(self, path: str):
        import sentencepiece

        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        self.bytes = {b: sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces of this model go over word starts")
        raw = [b""] * n
        for i in range(n):
            raw[i] = bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else sp.id_to_piece(i).replace(MARK, " ").encode()
        self.raw = raw
        self.stable = lru_cache(1 << 14)(self._stable)
        self.whole = lru_cache(1 << 16)(lambda s: len(s) == 1 or (s in self.ids and self.merged(s) == [s]))
        self.byte_ids = np.array([self.bytes[b] for b in range(256)], np.int32)
        # numbers of pieces: their ids, and n + code point for a character without one
        self.n = n
        self.single = np.arange(n, n + 0x110000, dtype=np.int32)
        for s, i in self.ids.items():
            if len(s) == 1:
                self.single[ord(s)] = i
        self.names = [sp.id_to_piece(i) for i in range(n)]
        # trie of the pieces: node 0 is the root and, as a child, stands for none
        joined = sorted({c for s in self.ids if len(s) > 1 for c in s})
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[[ord(c) for c in joined]] = np.arange(1, len(joined) + 1)
        inner = {s[:k] for s in self.ids for k in range(1, len(s))}
        self.node = {s: i for i, s in enumerate(["", *sorted(inner), *sorted({*(s for s in self.ids if len(s) > 1), *joined} - inner)])}
        self.n_inner = len(inner) + 1
        self.child = np.zeros((self.n_inner, len(joined) + 1), np.uint16 if len(self.node) < 1 << 16 else np.int32)
        self.piece = np.full(len(self.node), -1, np.int32)
        for s, i in self.node.items():
            if s:
                self.child[self.node[s[:-1]], self.kind[ord(s[-1])]] = i
                if self.whole(s):
                    self.piece[i] = self.single[ord(s)] if len(s) == 1 else self.ids[s]
        self.pair_keys, self.pair_known = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)

    def merged(self, s: str) -> list[str]:
        """The byte-pair encoding of a short string, as strings."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stable(self, a: str, b: str) -> bool:
        return self.merged(a + b) == [a, b]

    def piece_ids(self, s: str) -> list[int]:
        """The id of a piece, or the bytes of a character without one."""
        i = self.ids.get(s)
        return [i] if i is not None else [self.bytes[b] for b in s.encode()]

    def name(self, piece: int) -> str:
        return self.names[piece] if piece < self.n else chr(piece - self.n)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of pieces are stable; known pairs come from a table."""
        key = a.astype(np.int64) << 32 | b
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.pair_known[slot]
        miss = np.flatnonzero(self.pair_keys[slot] != key)
        if len(miss):
            new, where, back = np.unique(key[miss], return_index=True, return_inverse=True)
            stable = np.array([self.stable(self.name(k >> 32), self.name(k & 0xFFFFFFFF)) for k in new.tolist()], bool)
            out[miss] = stable[back]
            place, one = np.unique(slot[miss][where], return_index=True)
            self.pair_keys[place], self.pair_known[place] = new[one], stable[one]
        return out

    def long_word(self, word: str) -> list[str]:
        """The piece that ends at each place on the path from the word's start."""
        last = [""] * (len(word) + 1)
        for place in range(len(word)):
            for end in range(place + 1, len(word) + 1):
                s = word[place:end]
                node = self.node.get(s)
                if node is None:
                    break
                if not last[end] and self.piece[node] >= 0 and (not place or self.stable(last[place], s)):
                    last[end] = s
        return last[1:]

    def scan(self, code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where pieces end and their numbers, in code points joined from texts that begin at `first`.

        A prefix of a word has one encoding, so one piece with a path of weight 0
        from the word's start ends at each place; it is looked for in all words at once.
        """
        kind, mark = self.kind[code], code == ord(MARK)
        lone = kind == 0
        begins = lone | mark
        begins[1:] &= ~(mark[1:] & mark[:-1])
        begins[1:] |= lone[:-1]
        begins[first] = True
        start = np.flatnonzero(begins)
        stop = np.append(start[1:], len(code))
        last, size = np.full(len(code) + 1, -1, np.int32), np.ones(len(code) + 1, np.int16)
        alone = np.flatnonzero(lone)
        last[alone + 1] = self.single[code[alone]]
        for low, high in zip(start[stop - start > LANE].tolist(), stop[stop - start > LANE].tolist(), strict=True):
            found = self.long_word(code[low:high].tobytes().decode("utf-32-le"))
            last[low + 1 : high + 1] = [self.ids[s] if s in self.ids else self.single[ord(s)] for s in found]
            size[low + 1 : high + 1] = [len(s) for s in found]
        shared = (stop - start <= LANE) & ~lone[start]
        low, high = start[shared], stop[shared]
        order = np.argsort(low - high, kind="stable")
        low, high = low[order], high[order]
        for t in range(int(high[0] - low[0]) if len(low) else 0):
            lanes = np.searchsorted(low - high, -t)
            place, end, node = low[:lanes] + t, high[:lanes], np.zeros(lanes, self.child.dtype)
            prior = last[place]
            for k in range(1, self.longest + 1):
                node = self.child[node, kind[place + k - 1]]
                at, piece = place + k, self.piece[node]
                ok = np.flatnonzero((piece >= 0) & (last[at] < 0))
                if t:
                    ok = ok[self.pairs(prior[ok], piece[ok])]
                last[at[ok]], size[at[ok]] = piece[ok], k
                on = np.flatnonzero((node > 0) & (node < self.n_inner) & (at < end))
                if not len(on):
                    break
                place, end, node, prior = place[on], end[on], node[on], prior[on]
        ends = np.zeros(len(code) + 1, bool)
        low, at = start, stop
        while len(at):
            ends[at] = True
            at = at - size[at]
            on = at > low
            low, at = low[on], at[on]
        places = np.flatnonzero(ends)
        return places, last[places]

    def encoded(self, texts: list[str]) -> pa.ListArray:
        """Ids of texts in mark form that begin with a word start or are empty."""
        flat, counts = [], []
        low = 0
        while low < len(texts):
            high, total = low + 1, len(texts[low])
            while high < len(texts) and total + len(texts[high]) <= SCANNED:
                total += len(texts[high])
                high += 1
            part = texts[low:high]
            code = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
            stop = np.cumsum([len(t) for t in part])
            first = np.append(0, stop[:-1])
            places, pieces = self.scan(code, first[first < stop]) if len(code) else (np.zeros(0, np.int64), np.zeros(0, np.int32))
            bare = pieces >= self.n
            points = pieces[bare] - self.n
            width = np.ones(len(pieces), np.int64)
            width[bare] = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
            ids = np.repeat(pieces, width)
            ids[np.repeat(bare, width)] = self.byte_ids[np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)]
            flat.append(ids)
            ends = np.append(0, np.cumsum(width))[np.searchsorted(places, stop, "right")]
            counts.append(np.diff(ends, prepend=0))
            low = high
        offsets = np.append(0, np.cumsum(np.concatenate(counts))) if counts else np.zeros(1)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def tokens_over(self, text: str, at: int) -> list[tuple[int, int]]:
        """(start, end) of all pieces with start < at <= end, in a fixed order."""
        found = []
        for start in range(max(0, at - self.longest), at):
            for end in range(at, min(len(text), start + self.longest) + 1):
                if self.whole(text[start:end]):
                    found.append((start, end))
        return found

    def reach(self, text: str, begin: list[tuple[int, int] | None], low: int, stop: list[tuple[int, int]] | int) -> dict:
        """Pieces that can be reached from each begin state, as bit sets.

        `begin` are covering pieces, or [None] for a word start at `low`. `stop`
        are the end states, or the place of a word start where paths end. Gives
        {piece: {piece before: bits of begin states}}.
        """
        limit = stop if isinstance(stop, int) else max((e for _, e in stop), default=low)
        ends: dict[int, dict] = {}
        graph: dict = {}
        for i, state in enumerate(begin):
            place = low if state is None else state[1]
            ends.setdefault(place, {}).setdefault(state, 0)
            ends[place][state] |= 1 << i
        boundary = None if isinstance(stop, int) else min((e for _, e in stop), default=low)
        place = low
        while place < limit:
            before = ends.pop(place, None)
            if before and (boundary is None or place < boundary):
                for end in range(place + 1, min(limit, place + self.longest) + 1):
                    s = text[place:end]
                    if not self.whole(s):
                        continue
                    into = {}
                    for prior, bits in before.items():
                        if prior is None or self.stable(text[prior[0] : prior[1]], s):
                            into[prior] = bits
                    if into:
                        graph[place, end] = into
                        total = 0
                        for bits in into.values():
                            total |= bits
                        ends.setdefault(end, {})[place, end] = total
            place += 1
        return graph


class Chunk:
    """Transfer weights of one chunk and the ids between two boundary states."""

    def __init__(self, model: Model, text: str, low: int, high: int, first: bool, last: bool):
        """`text` holds a few characters around the chunk text[low:high]."""
        self.model, self.text, self.low, self.high = model, text, low, high
        self.begin = [None] if first else model.tokens_over(text, low)
        self.end = None if last else model.tokens_over(text, high)
        starts = [p for p in range(max(low, 1), high) if text[p] == MARK and text[p - 1] != MARK]
        if first:
            starts = [low, *[p for p in starts if p > low]]
        if starts:
            self.a, self.b = starts[0], starts[-1]
            self.head = model.reach(text, self.begin, low, self.a)
            self.tail = None if last else model.reach(text, [None], self.b, self.end)
        else:
            self.a = self.b = -1
            self.head, self.tail = model.reach(text, self.begin, low, high if last else self.end), None

    @staticmethod
    def _bits(graph: dict, piece: tuple[int, int]) -> int:
        bits = 0
        for b in graph.get(piece, {}).values():
            bits |= b
        return bits

    def _into(self, place: int) -> int:
        """Begin states from which a path ends at `place` in the head."""
        bits = 0
        for i, state in enumerate(self.begin):
            if (self.low if state is None else state[1]) == place:
                bits |= 1 << i
        for piece in self.head:
            if piece[1] == place:
                bits |= self._bits(self.head, piece)
        return bits

    def matrix(self) -> np.ndarray:
        """Max-plus transfer weights: begin states by end states."""
        row = lambda bits: np.array([0.0 if bits >> i & 1 else IMPOSSIBLE for i in range(len(self.begin))])
        if self.a >= 0:
            column = row(self._into(self.a))[:, None]
            out = np.array([[0.0]]) if self.end is None else np.array([[0.0 if self._bits(self.tail, e) else IMPOSSIBLE for e in self.end]])
            return column + out
        if self.end is None:
            return row(self._into(self.high))[:, None]
        return np.stack([row(self._bits(self.head, e)) for e in self.end], 1)

    def _back(self, graph: dict, bit: int, piece: tuple[int, int] | None, begin: list) -> list[tuple[int, int]]:
        path = []
        while piece is not None and piece in graph:
            path.append(piece)
            piece = next(prior for prior, bits in graph[piece].items() if bits >> bit & 1)
        return path[::-1]

    def ids(self, i: int, o: int) -> list[int]:
        """Ids of the pieces that start in the chunk, on the path from i to o."""
        out: list[int] = []
        end_at = self.a if self.a >= 0 else self.high
        if self.a >= 0 or self.end is None:
            closing = next((p for p, prior in self.head.items() if p[1] == end_at and any(b >> i & 1 for b in prior.values())), None)
        else:
            closing = self.end[o]
        pieces = self._back(self.head, i, closing, self.begin)
        for s, e in pieces:
            out += self.model.piece_ids(self.text[s:e])
        if self.a >= 0:
            stop = self.high if self.end is None else self.b
            out += self.model.encoded([self.text[self.a : stop]]).values.to_pylist()
            if self.end is not None:
                for s, e in self._back(self.tail, 0, self.end[o], [None]):
                    out += self.model.piece_ids(self.text[s:e])
        return out


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(1, initial=IMPOSSIBLE)


def best_states(matrices: list[np.ndarray]) -> list[int]:
    """The state of the best path at every boundary, by an associative scan.

    Products of neighbours are formed up a tree; then the weights from the start
    and to the end are handed down it.
    """
    n = len(matrices)
    states = [0] * (n + 1)

    def product(low: int, high: int) -> dict:
        if high - low == 1:
            return {"m": matrices[low], "low": low, "high": high}
        half = (low + high) // 2
        a, b = product(low, half), product(half, high)
        return {"m": max_plus(a["m"], b["m"]), "low": low, "high": high, "parts": (a, b)}

    stack = [(product(0, n), np.zeros((1, 1)), np.zeros((1, 1)))]
    while stack:
        node, before, after = stack.pop()
        if "parts" in node:
            a, b = node["parts"]
            left, right = max_plus(before, a["m"]), max_plus(b["m"], after)
            states[a["high"]] = int((left[0] + right[:, 0]).argmax())
            stack += [(a, before, right), (b, left, after)]
    return states


@lru_cache(2)
def load(path: str) -> Model:
    return Model(path)


def rows_of(batch: pa.RecordBatch, names: list[str]) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.select(names).slice(i, 1).to_pylist()[0]


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK, giant: int = GIANT, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All columns of `docs`, or those in `keep`, with `ids` (array of int) and `n_chunks`.

    `model` is the path of a byte-pair SentencePiece model that every executor has.
    """
    names = [c for c in (docs.columns if keep is None else keep) if not clash(c, ["ids", "n_chunks"])]
    carried = docs.select(packed(names), F.col(text_col).alias("text"))
    row_type = carried.schema["row"].dataType.simpleString()
    is_giant = F.coalesce(F.length("text") > giant, F.lit(False))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                ids = m.encoded([marked(t or "") for t in batch.column("text").to_pylist()])
                yield pa.record_batch({"row": batch.column("row"), "ids": ids, "n_chunks": pa.array(np.diff(ids.offsets) > 0).cast(pa.int64())})

    done = carried.where(~is_giant).mapInArrow(small, f"row {row_type}, ids array<int>, n_chunks long")
    large = carried.where(is_giant).withColumns({"k1": F.xxhash64(F.to_json("row")), "k2": F.xxhash64("text")})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halo = load(model).longest
        for batch in batches:
            for k1, k2, text in zip(batch.column("k1"), batch.column("k2"), batch.column("text").to_pylist(), strict=True):
                full = marked(text)
                n = -(-len(full) // chunk)
                for i in range(0, n, 64):
                    part = range(i, min(i + 64, n))
                    low = [max(0, j * chunk - halo) for j in part]
                    yield pa.record_batch({"k1": pa.array([k1.as_py()] * len(part), pa.int64()), "k2": pa.array([k2.as_py()] * len(part), pa.int64()), "i": pa.array(part, pa.int32()), "n": pa.array([n] * len(part), pa.int32()), "low": pa.array([j * chunk - at for j, at in zip(part, low, strict=True)], pa.int32()), "high": pa.array([min(len(full), (j + 1) * chunk) - at for j, at in zip(part, low, strict=True)], pa.int32()), "piece": pa.array([full[at : (j + 1) * chunk + halo] for j, at in zip(part, low, strict=True)], pa.string())})

    chunks = large.dropDuplicates(["k1", "k2"]).mapInArrow(split, "k1 long, k2 long, i int, n int, low int, high int, piece string").repartition("k1", "k2", "i")

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            out = []
            for r in rows_of(batch, ["i", "n", "low", "high", "piece"]):
                w = Chunk(m, r["piece"], r["low"], r["high"], r["i"] == 0, r["i"] == r["n"] - 1).matrix()
                out.append((w.shape[1], np.isfinite(w).astype(np.uint8).tobytes()))
            yield pa.record_batch({"k1": batch.column("k1"), "k2": batch.column("k2"), "i": batch.column("i"), "width": pa.array([w for w, _ in out], pa.int32()), "open": pa.array([b for _, b in out], pa.binary())})

    def scan(group: pa.Table) -> pa.Table:
        group = group.sort_by("i")
        weights = [np.where(np.frombuffer(b, np.uint8).reshape(-1, w) > 0, 0.0, IMPOSSIBLE) for w, b in zip(group.column("width").to_pylist(), group.column("open").to_pylist(), strict=True)]
        states = best_states(weights)
        return pa.table({"k1": group.column("k1"), "k2": group.column("k2"), "i": group.column("i"), "enter": pa.array(states[:-1], pa.int32()), "leave": pa.array(states[1:], pa.int32())})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                ids = [Chunk(m, r["piece"], r["low"], r["high"], r["i"] == 0, r["i"] == r["n"] - 1).ids(r["enter"], r["leave"]) for r in rows_of(part, ["i", "n", "low", "high", "piece", "enter", "leave"])]
                yield pa.record_batch({"k1": part.column("k1"), "k2": part.column("k2"), "i": part.column("i"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    states = chunks.mapInArrow(transfer, "k1 long, k2 long, i int, width int, open binary").groupBy("k1", "k2").applyInArrow(scan, "k1 long, k2 long, i int, enter int, leave int")
    traced = chunks.join(states, ["k1", "k2", "i"]).mapInArrow(trace, "k1 long, k2 long, i int, ids array<int>")
    joined = traced.groupBy("k1", "k2").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "ids"))), lambda x: x["ids"])).alias("ids"), F.count("*").alias("n_chunks"))
    long_ = large.drop("text").join(joined, ["k1", "k2"]).select("row", "ids", "n_chunks")
    return done.union(long_).select(*unpacked(names), "ids", "n_chunks")


def decode(tokens: DataFrame, model: str = MODEL, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns with `decoded`, the text of the ids; null ids give an empty text."""
    names = [c for c in tokens.columns if not clash(c, [out_col])]
    others = [c for c in names if c != ids_col]
    carried = tokens.select(packed(others), F.col(ids_col).alias("ids"))
    row_type = carried.schema["row"].dataType.simpleString()

    def texts(m: Model, ids: pa.ListArray) -> list[str]:
        at, flat = np.asarray(ids.offsets).tolist(), ids.values.to_numpy(zero_copy_only=False)
        flat = flat[at[0] : at[-1]].tolist()
        return [m.decode(flat[a - at[0] : b - at[0]]) if ok else "" for a, b, ok in zip(at[:-1], at[1:], ids.is_valid().to_pylist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                yield pa.record_batch({"row": batch.column("row"), "ids": batch.column("ids"), "out": pa.array(texts(m, batch.column("ids")), pa.string())})

    done = carried.mapInArrow(run, f"row {row_type}, ids array<int>, out string")
    own = dict(zip(others, unpacked(others), strict=True))
    return done.select(*[own.get(n, F.col("ids").alias(n)) for n in names], F.col("out").alias(out_col))


def encoded_summary(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, n_chunks, ids_hash, decoded_sha256 and round_trip."""
    want = F.sha2(F.coalesce(F.replace("text", F.lit(MARK), F.lit(" ")), F.lit("")), 256)
    coded = encode(docs.select("doc_id", "text", want.alias("want")), model, keep=["doc_id", "want"])
    back = decode(coded, model)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "n_chunks", F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.sha2("decoded", 256) == F.col("want")).alias("round_trip"))


def op2_sentencepiece(spark, sf_dir):
    return encoded_summary(table(spark, sf_dir, "documents"))


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
