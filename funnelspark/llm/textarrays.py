"""Words and shingles of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of characters other than space and the control characters 9 to
13. UTF-8 never uses those bytes inside a longer character, so words of bytes
are words of code points. Hashes are polynomials over the 64-bit integers with
random odd base and random byte values, finished with a bit mixer; they don't
depend on the process, the batch or the position in it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(1, 2**62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_STEPS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1); long texts get their own, short ones share."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row starts and the last one ends. Null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


@dataclass
class Spans:
    """Spans of bytes in row order: start, end, and the row each lies in."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    rows: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)


def _runs(inside: np.ndarray, offsets: np.ndarray) -> Spans:
    """Runs of True that don't cross a row's end."""
    starts, ends = inside.copy(), inside.copy()
    if len(inside):
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        first = offsets[:-1][np.diff(offsets) > 0]
        starts[first] = inside[first]
        last = offsets[1:][np.diff(offsets) > 0] - 1
        ends[last] = inside[last]
    start = np.flatnonzero(starts)
    return Spans(start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, side="right") - 1, len(offsets) - 1)


def runs(inside: np.ndarray, offsets: np.ndarray) -> Spans:
    """Runs of the bytes where ``inside`` holds, row by row."""
    return _runs(inside, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> Spans:
    return _runs(~_SPACE[data], offsets)


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def lines(data: np.ndarray, offsets: np.ndarray) -> Spans:
    """The lines between line feeds; a row without text has one empty line."""
    feeds = np.flatnonzero(data == 10)
    rows = len(offsets) - 1
    start = np.concatenate([offsets[:-1], feeds + 1])
    end = np.concatenate([feeds, offsets[1:]])
    row = np.concatenate([np.arange(rows), np.searchsorted(offsets, feeds, side="right") - 1])
    order = np.argsort(row, kind="stable")
    start, row = start[order], row[order]
    # ends in the same order: each line ends at its own row's next feed or at the row's end
    erow = np.concatenate([np.searchsorted(offsets, feeds, side="right") - 1, np.arange(rows)])
    end = end[np.argsort(erow, kind="stable")]
    return Spans(start, end, row, rows)


def hashes(data: np.ndarray, spans: Spans, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; ``lower`` folds A-Z."""
    if lower:
        data = _LOWER[data]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * _power(_BASE, len(data)), out=sums[1:])
    length = (spans.end - spans.start).astype(np.uint64)
    start = np.minimum(spans.start, max(len(data) - 1, 0))
    back = _power(_INVERSE, max(len(data), 1))[start]
    return mix((sums[spans.end] - sums[spans.start]) * back + length * np.uint64(0x9E3779B97F4A7C15))


def grams(word: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words within a row, and its row."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = word[:n] * _STEPS[0]
    for j in range(1, size):
        total = total + word[j : j + n] * _STEPS[j]
    whole = row[:n] == row[size - 1 :]
    return mix(total)[whole], row[:n][whole]


def sorted_in_rows(row: np.ndarray, value: np.ndarray, places: bool = False) -> np.ndarray:
    """Values sorted within each row, where rows come in order; with ``places``, the order that sorts them."""
    edges = np.flatnonzero(np.diff(row)) + 1
    bounds = np.concatenate([[0], edges, [len(row)]]).tolist()
    out = np.arange(len(row)) if places else value.copy()
    for start, end in zip(bounds, bounds[1:]):
        if end - start > 1:
            if places:
                out[start:end] = np.argsort(value[start:end]) + start
            else:
                out[start:end].sort()
    return out


def distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (row, value) pairs in order, and how often each occurs."""
    if len(row) > 1 and (np.diff(row) < 0).any():
        order = np.argsort(row, kind="stable")
        row, value = row[order], value[order]
    value = sorted_in_rows(row, value)
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(row)))


def shingles(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles (row, hash) of each text, lower-cased in A-Z, ordered by row and hash.

    A text of fewer words than ``size`` has its whole sequence as one shingle; a text without words has none.
    """
    data, offsets = utf8(column)
    spans = words(data, offsets)
    word = hashes(data, spans, lower=True)
    value, row = grams(word, spans.row, size)
    counts = spans.counts()
    first = np.cumsum(counts) - counts
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            total = np.full(len(short), n, dtype=np.uint64)
            for j in range(n):
                total = total + word[first[short] + j] * _STEPS[j + 8]
            value, row = np.concatenate([value, mix(total)]), np.concatenate([row, short])
    row, value, _ = distinct(row, value)
    return row, value
