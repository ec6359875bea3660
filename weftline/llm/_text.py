"""Vectorised helpers for whole texts inside Arrow batches.

All helpers treat a null text as empty and look at every byte of a text.
Words are maximal runs outside space and the control characters 9 to 13.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: Bytes of text that are hashed at once.
WINDOW = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, WINDOW + 1), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 4 * WINDOW:
            _powers[int(base)] = have
    return have[:n]


def rolling_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of overlapping byte spans [start, end), from one prefix sum.

    They order places of a text. Texts can be made that collide, so nothing may
    count as equal by them.
    """
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, n), dtype=np.uint64, out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * _power(_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def groups(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = WINDOW) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most `limit` bytes of text, or one row."""
    for batch in batches:
        data, at = utf8(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n+1 word offsets of the rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~IS_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


#: Spans of more bytes are hashed one by one.
LANES = 128
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of separate byte spans, for equality.

    Eight bytes of all spans at a time go through a mixer that is no polynomial,
    so that strings of a special form collide no more often than others.
    """
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(np.uint64) * _BASE)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # unaligned loads
    live = np.flatnonzero((size > 0) & (size <= LANES))
    for k in range(0, LANES, 8):
        live = live[size[live] > k]
        if not len(live):
            break
        part = eight[starts[live] + k] & _KEEP[np.minimum(size[live] - k, 8)]
        out[live] = mix(out[live] ^ part) + _BASE
    long = np.flatnonzero(size > LANES)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        out[long] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return mix(out)


def window_hashes(data: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashes of all windows of `size` bytes, for equality.

    Windows of twice the size are mixed from two halves, so no sum of terms can
    cancel out.
    """
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, width, done, out = mix(data.astype(np.uint64) + np.uint64(seed << 8)), 1, 0, None
    while True:
        if size & width:
            part = level[done : done + n]
            out = part.copy() if out is None else mix(out * _BASE + part)
            done += width
        if done == size:
            return out
        level = mix(level[:-width] * _INVERSE + (level[width:] ^ _BASE))
        width *= 2


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A to Z in lower case and all others as they are."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
