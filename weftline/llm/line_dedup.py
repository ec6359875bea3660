"""Line dedup with content-defined line chunks (operator 1).

A text is cut into lines; a rolling hash over the hashes of neighbouring lines
chooses chunk boundaries, so an inserted line moves only the chunks around it.
Units are the chunks of several lines, and each two neighbouring lines with words, along
with the blank lines between them. The pairs grow a repeated run line by line to both of
its ends, where its first and last chunk also hold lines of their own document, and find
runs that are too short to hold a chunk. Units that occur more than once in the corpus are removed everywhere but at their first place
(smallest doc_id, then line), after their bytes have been compared. Units may
overlap; a line goes if any unit over it goes. Each removed line still stands at an
earlier place, as the places of its removals lead back to a first one.

Only hashes are exchanged for all units. The bytes of repeated ones are then
compared by grouping on them, which combines within each task first, so a unit
that a third of all documents hold is one row a task. Units whose keys are equal
but whose bytes differ are told apart by their bytes.

Defined cases: a null text has no lines and stays null; an empty text stays
empty, as does one of which every line is removed; single lines and units with
fewer than two lines with words are never removed; chunks end after LONGEST lines,
so that periodic texts, whose rolling hash may never or always end a chunk, lose
their repeats too; rows with equal doc_id and text are one document, whose places
count once, and all of them get the same result; rows with equal doc_id and other
texts are documents of their own; a null doc_id comes first; other columns pass
through, but a column named like an added one is replaced by it; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import _text
from weftline.llm._graph import clash, cut, packed, quoted, table, unpacked

#: Lines that the rolling hash sees, lines of an average chunk, and of the longest.
ROLL, AVERAGE, LONGEST = 2, 2, 64
#: Columns that dedup_lines adds.
ADDED = ["_n_lines", "_n_removed_lines", "_n_removed_chunks"]
_K = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = pow(int(_K), -1, 1 << 64)


class Lines:
    """The lines of the texts of a batch: byte spans, and the first line of each text."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        breaks = np.flatnonzero(data == 10)
        self.per = np.diff(np.searchsorted(breaks, at)) + 1
        self.line_at = np.concatenate(([0], np.cumsum(self.per)))
        n = int(self.line_at[-1])
        first, last = np.empty(n, np.int64), np.empty(n, np.int64)
        self.lead, self.tail = np.zeros(n, bool), np.zeros(n, bool)
        self.lead[self.line_at[:-1]], self.tail[self.line_at[1:] - 1] = True, True
        first[self.lead], first[~self.lead] = at[:-1], breaks + 1
        last[self.tail], last[~self.tail] = at[1:], breaks
        self.first, self.last = first, last


class Units(Lines):
    """Chunks and pairs of lines: text, first line in it, number of lines, two keys."""

    def __init__(self, data: np.ndarray, at: np.ndarray, roll: int = ROLL, average: int = AVERAGE, longest: int = LONGEST, bits: int = 64):
        super().__init__(data, at)
        n = len(self.first)
        starts, ends, _ = _text.words(data, at)
        filled = np.searchsorted(starts, self.last) > np.searchsorted(starts, self.first)
        hashes = _text.span_hashes(data, self.first, self.last)
        text = np.repeat(np.arange(len(self.per)), self.per)
        place = np.arange(n) - self.line_at[text]
        rolled = np.zeros(n, np.uint64)
        for k in range(roll):
            seen = np.flatnonzero(place >= k)
            rolled[seen] = rolled[seen] * _K + hashes[seen - k]
        self.close = self.tail | ((place + 1 >= roll) & (_text.mix(rolled) % np.uint64(average) == 0))
        begin = np.maximum.accumulate(np.where(np.concatenate(([True], self.close[:-1])), np.arange(n), 0)) if n else place
        self.close |= (np.arange(n) - begin + 1) % longest == 0
        stop = np.flatnonzero(self.close)
        start = np.concatenate(([0], stop[:-1] + 1)) if n else stop
        # spans of lines: whole chunks, and neighbours with words
        with_words = np.flatnonzero(filled)
        low, high = np.concatenate((start, with_words[:-1])), np.concatenate((stop, with_words[1:]))
        ok = high > low
        low, high = low[ok], high[ok]
        low, high = np.unique(np.stack((low, high), 1)[text[low] == text[high]], axis=0).T if len(low) else (low, high)
        total = np.concatenate(([0], np.cumsum(filled)))
        several = total[high + 1] - total[low] >= 2
        low, high = low[several], high[several]
        self.text, self.n, self.m = text[low], place[low], high - low + 1
        power, inverse = np.full(n + 1, _K, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
        power[0] = inverse[0] = 1
        power, inverse = np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
        self.keys = []
        for salt in (0x51, 0xA3):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_text.mix(hashes ^ np.uint64(salt)) * power[:n], dtype=np.uint64)))
            key = _text.mix((sums[high + 1] - sums[low]) * inverse[low] + self.m.astype(np.uint64))
            self.keys.append((key >> np.uint64(64 - bits)).view(np.int64))


def _keyed(docs: DataFrame) -> DataFrame:
    """The text with a key of equal (doc_id, text), apart from other columns."""
    return docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t"), F.col("text").alias("text"))


def _same(a: str, b: str):
    return F.col(f"{a}._id").eqNullSafe(F.col(f"{b}._id")) & (F.col(f"{a}._t") == F.col(f"{b}._t"))


def removed_lines(docs: DataFrame, roll: int = ROLL, average: int = AVERAGE, longest: int = LONGEST, bits: int = 64) -> DataFrame:
    """(_id, _t, gone): the line spans (n, m) to remove from each document that loses any.

    Only tests keep fewer `bits` of the keys, so that keys collide.
    """
    keyed = _keyed(docs)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    columns = f"_id {id_type}, _t long, n int, m int, h long, g long"

    def rows(batch: pa.RecordBatch, u: Units, i: np.ndarray) -> dict:
        at = pa.array(u.text[i])
        return {"_id": batch.column("_id").take(at), "_t": batch.column("_t").take(at), "n": pa.array(u.n[i], pa.int32()), "m": pa.array(u.m[i], pa.int32()), "h": u.keys[0][i], "g": u.keys[1][i]}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in _text.groups(batches):
            u = Units(data, at, roll, average, longest, bits)
            yield pa.record_batch(rows(batch, u, np.arange(len(u.n))))

    units = cut(keyed.mapInArrow(places, columns))
    # cut, so that the joins get exchanges of their own and hot units can be split
    repeated = cut(units.groupBy("h", "g").agg(F.count("*").alias("uses")).where("uses > 1").select("h", "g"))
    marks = cut(units.join(repeated, ["h", "g"]))
    wanted = marks.groupBy("_id", "_t").agg(F.collect_set(F.struct("n", "m")).alias("wanted"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in _text.groups(batches):
            u = Units(data, at, roll, average, longest, bits)
            asked = batch.column("wanted")
            doc, flat = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(asked.offsets))), asked.flatten()
            have = {key: i for i, key in enumerate(zip(u.text.tolist(), u.n.tolist(), u.m.tolist(), strict=True))}
            i = np.array([have[key] for key in zip(doc.tolist(), flat.field(0).to_pylist(), flat.field(1).to_pylist(), strict=True)], np.int64)
            low = u.line_at[u.text[i]] + u.n[i]
            raw, start, end = data.tobytes(), u.first[low].tolist(), u.last[low + u.m[i] - 1].tolist()
            yield pa.record_batch({**rows(batch, u, i), "unit": pa.array([raw[a:b] for a, b in zip(start, end, strict=True)], pa.binary())})

    pulled = keyed.alias("d").join(wanted.alias("w"), _same("d", "w")).select("d._id", "d._t", "text", "wanted")
    bytes_ = pulled.mapInArrow(texts, f"{columns}, unit binary")
    place = F.struct("_id", "_t", "n")
    compared = bytes_.groupBy("h", "g", "unit").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    kept = cut(compared.groupBy("h", "g").agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.max("last").alias("last")))
    gone = marks.join(kept.where("texts = 1 and first <> last").select("h", "g", "first"), ["h", "g"]).where(place != F.col("first")).select("_id", "_t", "n", "m")
    mixed = kept.where("texts > 1").select("h", "g")
    if not mixed.isEmpty():  # equal keys of other bytes: judged by the bytes
        again = cut(bytes_.join(mixed, ["h", "g"]))
        firsts = again.groupBy("h", "g", "unit").agg(F.min(place).alias("first"))
        gone = gone.union(again.join(firsts, ["h", "g", "unit"]).where(place != F.col("first")).select("_id", "_t", "n", "m"))
    return gone.groupBy("_id", "_t").agg(F.collect_set(F.struct("n", "m")).alias("gone"))


def dedup_lines(docs: DataFrame, roll: int = ROLL, average: int = AVERAGE, longest: int = LONGEST, bits: int = 64) -> DataFrame:
    """All columns of `docs` with the text that is left, and line counts.

    Added columns (longs): _n_lines, _n_removed_lines, and _n_removed_chunks, the
    maximal runs of removed lines.
    """
    gone = removed_lines(docs, roll, average, longest, bits)
    names = [n for n in docs.columns if not clash(n, ADDED)]
    carried = [n for n in names if n != "text"]
    left = docs.select(packed(carried), "text", F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t"))
    both = left.alias("d").join(gone.alias("g"), _same("d", "g"), "left").select("row", "text", "gone")
    row_type = left.schema["row"].dataType.simpleString()

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in _text.groups(batches):
            x = Lines(data, at)
            out, lost, runs, raw = [], [], [], data.tobytes()
            for i, spans in enumerate(batch.column("gone").to_pylist()):
                if spans is None:
                    out.append(batch.column("text")[i].as_py())
                    lost.append(0)
                    runs.append(0)
                    continue
                a, b = int(x.line_at[i]), int(x.line_at[i + 1])
                drop = np.zeros(b - a + 1, np.int64)
                for s in spans:
                    drop[s["n"]] += 1
                    drop[s["n"] + s["m"]] -= 1
                drop = np.cumsum(drop)[:-1] > 0
                keep = a + np.flatnonzero(~drop)
                out.append(b"\n".join([raw[p:q] for p, q in zip(x.first[keep].tolist(), x.last[keep].tolist(), strict=True)]).decode())
                lost.append(int(drop.sum()))
                runs.append(int((drop & ~np.concatenate(([False], drop[:-1]))).sum()))
            lines = np.where(np.asarray(batch.column("text").is_null()), 0, x.per)
            yield pa.record_batch({"row": batch.column("row"), "new_text": pa.array(out, pa.string()), **{c: pa.array(v, pa.int64()) for c, v in zip(ADDED, (lines, lost, runs), strict=True)}})

    done = both.mapInArrow(strip, f"row {row_type}, new_text string, " + ", ".join(f"{c} long" for c in ADDED))
    return done.select(*unpacked(carried), F.col("new_text").alias("text"), *ADDED).select(*quoted(names), *ADDED)


def op1_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = dedup_lines(docs)
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed_lines").alias("n_removed_lines"), F.col("_n_removed_chunks").alias("n_removed_chunks"), F.length(F.encode("text", "UTF-8")).cast("long").alias("n_bytes_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op1_line_dedup": op1_line_dedup}
