"""Vectorised work on the UTF-8 bytes of an Arrow string column: words, word hashes and shingle sets.

White space (0x20, 0x09-0x0D) and A-Z are ASCII, so splitting and lower-casing bytes is exact on UTF-8.
Words and shingles are carried as 64-bit hashes.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
_LETTER = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LETTER[_SPACE] = 0
_LETTER_LOWER = _LETTER.copy()
_LETTER_LOWER[65:91] = _LETTER[97:123]


_MEMORIES: dict[str, Callable[[], None]] = {}


def begin(operator: str, forget: Callable[[], None] | None = None) -> None:
    """An operator begins in this worker process: what others remember here is dropped.  ``forget`` drops its own."""
    for other, drop in _MEMORIES.items():
        if other != operator:
            drop()
    if forget:
        _MEMORIES[operator] = forget


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def places(n: int) -> np.ndarray:
    """The first ``n`` odd multipliers, one for each position in a word."""
    global _PLACE
    if n > len(_PLACE):
        more = mix(np.arange(len(_PLACE), 2 * n, dtype=np.uint64), 7) | np.uint64(1)
        _PLACE = np.concatenate([_PLACE, more])
    return _PLACE[:n]


def text_slices(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole rows with about ``limit`` bytes; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, raw[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of bytes that are not white space; no word crosses rows."""
    return runs(~_SPACE[data], offsets)


def runs(ink: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of marked bytes; none crosses rows."""
    first, last = ink.copy(), ink.copy()
    if len(ink):
        first[1:] &= ~ink[:-1]
        last[:-1] &= ~ink[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(ink))]
        first[edges] = ink[edges]
        last[edges - 1] = ink[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z lower-cased first if asked."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    begin = starts - starts[0]
    data = data[starts[0]:]
    gaps = np.diff(begin, append=len(data))
    place = np.arange(len(data), dtype=np.int32) - np.repeat(begin.astype(np.int32), gaps)
    np.minimum(place, np.int32(lengths.max()), out=place)
    value = (_LETTER_LOWER if lower else _LETTER)[data]
    value *= places(int(lengths.max()) + 1)[place]
    sums = np.add.reduceat(value, begin)
    return mix(sums + lengths.astype(np.uint64))


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, words per row) of all word ``width``-grams; a shorter row is one shingle of all its words."""
    count = np.bincount(rows, minlength=n_rows)
    begin = np.cumsum(count) - count
    step = mix(np.arange(width, dtype=np.uint64), 11) | np.uint64(1)
    n = max(0, len(hashes) - width + 1)
    full = np.zeros(n, np.uint64)
    for k in range(width):
        full += hashes[k:k + n] * step[k]
    inside = rows[:n] == rows[width - 1:width - 1 + n] if n else np.zeros(0, bool)
    out, of = [mix(full[inside], 3)], [rows[:n][inside]]
    for size in range(1, width):
        short = np.flatnonzero(count == size)
        if len(short):
            total = np.full(len(short), size, np.uint64)
            for k in range(size):
                total += hashes[begin[short] + k] * step[k]
            out.append(mix(total, 100 + size))
            of.append(short)
    return np.concatenate(out), np.concatenate(of), count
