"""Words and word shingles of whole Arrow columns of text, as numpy arrays of 64-bit hashes.

Works on the UTF-8 bytes of a batch: words are runs of bytes other than space and \\t \\n \\v \\f \\r, A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
#: Texts are worked on in slices of about so many bytes, which bounds memory; a longer text is a slice of its own.
SLICE_BYTES = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Gaps between words of letters and digits alone: every other ASCII byte.
PUNCTUATED = np.ones(256, bool)
PUNCTUATED[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit number over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, start: int = 0) -> np.ndarray:
    return mix((np.arange(n, dtype=np.uint64) + np.uint64(start + 1)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = seeds(256, 7)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = seeds(SHINGLE, 1000) | np.uint64(1)
_powers = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        table = np.full(max(n, 1 << 16), base, np.uint64)
        table[0] = 1
        _powers[base] = known = np.cumprod(table)
    return known[:n]


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first row, bytes, offsets) of successive slices; null texts are empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE_BYTES, "right")) - 1)
        yield first, data[ends[first]:ends[last]], ends[first:last + 1] - ends[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every word; `gaps` tells which bytes separate words."""
    space = gaps[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner], after[inner - 1] = True, True
    start = np.flatnonzero(~space & before)
    return np.searchsorted(offsets, start, "right") - 1, start, np.flatnonzero(~space & after) + 1


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums over the folded bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_FOLD[data]] * _power(_BASE, len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans: differences of prefix sums, moved to the span's start, then mixed with its length."""
    return mix((sums[end] - sums[start]) * _power(_INVERSE, len(sums))[start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hashes(byte_sums(data), start, end)


def shingles(row: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all shingles of five words; a row with fewer words gives one, of the whole sequence."""
    n = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    start = np.flatnonzero(row[:len(row) - SHINGLE + 1] == row[SHINGLE - 1:]) if len(row) >= SHINGLE else np.zeros(0, np.int64)
    total = np.zeros(len(start), np.uint64)
    for k in range(SHINGLE):
        total += hashes[start + k] * _PLACE[k]
    whole = n[short].astype(np.uint64)
    for k in range(SHINGLE - 1):
        has = n[short] > k
        whole[has] += hashes[first[short][has] + k] * _PLACE[k]
    return np.concatenate((row[start], short)), mix(np.concatenate((total, whole)))


def sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(index of the first row, rows, set sizes, all rows' distinct shingles one row after the other, ascending)."""
    for first, data, offsets in slices(column):
        rows = len(offsets) - 1
        row, start, end = words(data, offsets)
        row, values = shingles(row, word_hashes(data, start, end), rows)
        order = np.lexsort((values, row))
        row, values = row[order], values[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
        yield first, rows, np.bincount(row[new], minlength=rows), values[new]
