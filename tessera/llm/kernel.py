"""Vectorised word kernels over Arrow batches (NumPy, no per-word Python).

A word is a maximal run of bytes outside a delimiter set. Its 64-bit hash is a
polynomial over randomly mapped bytes, computed for all words of a chunk at
once from one prefix sum (multiplying by inverse powers of the odd base), then
finalised. Chunks hold about a megabyte of text, or one longer text, so memory
is bounded by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(
    1, 1 << 63, 256, dtype=np.uint64
)

#: Bytes that part words: space and the controls \x09-\x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII other than letters and digits parts words; other characters belong to words.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[:128] = [not chr(i).isalnum() for i in range(128)]

_FOLDED = _BYTE_VALUE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _BYTE_VALUE[ord("a") : ord("z") + 1]

_powers: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, delimiters: np.ndarray = SPACES, fold: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[offsets[i]:offsets[i+1]], and each
    text's first word index (one entry more than texts)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~delimiters[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1]
    before[cuts[cuts < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = offsets[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    powers, inverses = _power_tables(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((_FOLDED if fold else _BYTE_VALUE)[data] * powers, out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverses[starts])
    return hashes, np.searchsorted(starts, offsets)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) pieces of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    count = len(column)
    if not count:
        return
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + count + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    low = 0
    while low < count:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), count)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of `size` words; a shorter sequence gives one hash of
    the whole, no words give none."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    m = len(words) - size + 1
    out = np.full(m, np.uint64(size), np.uint64)
    for k in range(size):
        out = mix(out * _BASE + words[k : k + m])
    return out


def run_shingles(words: np.ndarray, first: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text of a chunk."""
    m = len(words) - size + 1
    every = shingle_hashes(words, size) if m > 0 else None
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if high - low >= size:
            out.append(np.unique(every[low : high - size + 1]))
        else:
            out.append(np.unique(shingle_hashes(words[low:high], size)))
    return out


def rolling_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of every window of exactly `size` words: a polynomial over the
    words' hashes, from one prefix sum, finalised."""
    m = len(words) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    powers, inverses = _power_tables(len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers, out=total[1:])
    return mix((total[size:] - total[:-size]) * inverses[:m])
