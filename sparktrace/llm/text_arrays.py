"""Numpy views of Arrow text columns: words, word hashes and shingle sets, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        have = _powers[int(base)] = np.cumprod(have, dtype=U64)
    return have[:n]


def texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text as uint8; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    at = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    for i in range(len(column)):
        yield data[at[i] : at[i + 1]]


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edges = np.flatnonzero(np.diff(inside))
    return edges[0::2], edges[1::2]


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hash of each word of lower-cased bytes, in order."""
    starts, ends = word_bounds(raw)
    if not len(starts):
        return np.zeros(0, dtype=U64)
    sums = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum((raw.astype(U64) + U64(1)) * powers(BASE, len(raw)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(raw) + 1)[starts])


def shingle_set(raw: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the `width`-word shingles; fewer words make one shingle; none without words."""
    w = word_hashes(lower(raw))
    if not len(w):
        return w
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, U64(k), dtype=U64)
    for j in range(k):
        h = h + w[j : len(w) - k + 1 + j] * (powers(BASE, width + 2)[j + 1])
    return np.unique(mix(h))
