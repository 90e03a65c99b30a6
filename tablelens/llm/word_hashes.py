"""Words of many texts at once as 64-bit hashes, over the bytes of an Arrow column.

Words are `[^\\x20\\x09-\\x0D]+`, A to Z lower-cased: both are decided by single bytes, so UTF-8 is never decoded. A word's
hash is a polynomial over its bytes, read off running sums, and then mixed; two different words or word sequences meet
in one of 2**64 values only by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once; a longer text is hashed by itself.
BYTES_AT_ONCE = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(0, _U), np.ones(0, _U))


class Words(NamedTuple):
    first_row: int  # row of the batch that row 0 stands for
    rows: int
    row: np.ndarray  # of each word, ascending
    hashes: np.ndarray
    starts: np.ndarray  # byte offsets in `data`
    ends: np.ndarray
    data: np.ndarray
    bounds: np.ndarray  # word offsets of the rows, rows + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose outputs look random."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        def table(base: int) -> np.ndarray:
            steps = np.full(n, base, _U)
            steps[0] = 1
            return np.cumprod(steps, dtype=_U)
        _powers = table(_BASE), table(_INVERSE)
    return _powers


def words_of(column: pa.Array) -> Iterator[Words]:
    """The words of a string column in slices of bounded bytes; NULL texts have none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES_AT_ONCE, "right")) - 1)
        upto = min(upto, len(column))
        yield _slice(at, data[offsets[at]:offsets[upto]], offsets[at:upto + 1] - offsets[at])
        at = upto


def _slice(first_row: int, data: np.ndarray, offsets: np.ndarray) -> Words:
    rows, n = len(offsets) - 1, len(data)
    letter = ~_SPACE[data]
    begin = letter.copy()
    begin[1:] &= ~letter[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    begin[inner] = letter[inner]  # a row's first byte begins a word whatever ends the row before it
    stop = letter.copy()
    stop[:-1] &= ~letter[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    stop[last] = letter[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    powers, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum((_LOWER[data].astype(_U) + _U(1)) * powers[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))
    bounds = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    return Words(first_row, rows, row, hashes, starts, ends, data, bounds)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds by row) of all n-word sequences in order; a row with fewer words, but one, has its whole
    sequence as the only one."""
    h, count = words.hashes, np.diff(words.bounds)
    total = len(h)
    out = np.zeros(max(0, total - n + 1), _U)
    for k in range(n):
        out = mix(out ^ h[k:k + len(out)]) + _U(n)
    keep = np.zeros(total, bool)
    if total >= n:
        keep[:total - n + 1] = words.row[:total - n + 1] == words.row[n - 1:]
    values = np.zeros(total, _U)
    values[:len(out)] = out
    for r in np.flatnonzero((count > 0) & (count < n)).tolist():
        a, b = words.bounds[r], words.bounds[r + 1]
        whole = np.zeros(1, _U)
        for x in h[a:b]:
            whole = mix(whole ^ x) + _U(b - a)
        values[a], keep[a] = whole[0], True
    before = np.zeros(total + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return values[keep], before[words.bounds]
