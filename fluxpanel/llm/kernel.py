"""Words of many texts at once, on the UTF-8 bytes of an Arrow column.

Words are the runs of bytes that are not separators; by default the separators are U+0020 and U+0009..U+000D. Each
word gets a 64-bit hash: a multilinear sum of random numbers by byte and by place, then a bijective finaliser. A null
text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators for bare words: all ASCII but letters and digits. Bytes of longer characters count as letters.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SLICE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = np.asarray(x, U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def numbers(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) ^ mix(np.array([seed], U64)))


BYTE = numbers(256, 1)
_place = numbers(4096, 2) | U64(1)


def place(n: int) -> np.ndarray:
    """Odd multipliers for the first n places of a word."""
    global _place
    if n > len(_place):
        _place = numbers(1 << int(n - 1).bit_length(), 2) | U64(1)
    return _place


def texts(col: pa.Array | pa.ChunkedArray) -> pa.LargeBinaryArray:
    """A string column as bytes, nulls as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")


def slices(col: pa.LargeBinaryArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) for runs of rows of about ``limit`` bytes; a longer text is a run of its own."""
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j - i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def split(data: np.ndarray, at: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets by text) of the words."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~sep[data]
    first, last = inside.copy(), inside.copy()
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans that don't overlap, in ascending order; spans may be empty."""
    n = ends - starts
    out = np.zeros(len(starts), U64)
    if not len(starts):
        return out
    full = np.flatnonzero(n)
    total = int(n.sum())
    if total:
        m = n[full]
        begin = np.cumsum(m) - m
        within = np.arange(total) - np.repeat(begin, m)
        where = within + np.repeat(starts[full], m)
        b = data[where]
        out[full] = np.add.reduceat(BYTE[LOWER[b] if lower else b] * place(int(m.max()))[within], begin)
    return mix(out + n.astype(U64) * U64(0x9E3779B97F4A7C15))


def windows(h: np.ndarray, woff: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``size`` words that lies in one text."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    ok = np.zeros(len(h) + 1, bool)
    count = np.diff(woff)
    last = woff[1:] - size + 1
    keep = count >= size
    step = np.zeros(len(h) + 2, np.int64)
    np.add.at(step, woff[:-1][keep], 1)
    np.add.at(step, last[keep], -1)
    ok = np.cumsum(step)[: len(h)] > 0
    first = np.flatnonzero(ok)
    return first, window_hash(h, first, size, seed)


def window_hash(h: np.ndarray, first: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words at the given first words."""
    m = numbers(size, seed) | U64(1)
    out = np.zeros(len(first), U64)
    for k in range(size):
        out += h[first + k] * m[k]
    return mix(out)


def covered(first: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a run of ``size`` words at one of the first words."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, np.minimum(first + size, n), -1)
    return np.cumsum(step)[:n] > 0
