"""Sparse matrices in compressed rows, kept as numpy arrays, and their row products."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Terms of a product that are held at once.
BLOCK = 4_000_000


class Csr(NamedTuple):
    """Row r has the columns `columns[starts[r]:starts[r + 1]]` with the values beside them."""
    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def gather(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n_rows: int) -> Csr:
    """Entries in any order, those of one place added up, columns ascending in each row."""
    width = int(columns.max()) + 1 if len(columns) else 1
    places, back = np.unique(rows.astype(np.int64) * width + columns, return_inverse=True)
    sums = np.bincount(back, values, len(places)).astype(np.int64)
    row = places // width
    return Csr(np.searchsorted(row, np.arange(n_rows + 1)), places % width, sums)


def product(a: Csr, b: Csr) -> Csr:
    """Gustavson's product: row r of the result is the sum of those rows of `b` that the entries of row r of `a` name, times
    their values. Rows are taken in blocks whose terms are bounded (one row alone may be larger)."""
    n_rows, sizes = len(a.starts) - 1, np.diff(b.starts)[a.columns]
    before = np.concatenate([[0], np.cumsum(sizes)])[a.starts]  # terms of all rows before
    parts, at = [], 0
    while at < n_rows:
        to = max(at + 1, int(np.searchsorted(before, before[at] + BLOCK, "right")) - 1)
        some = slice(a.starts[at], a.starts[to])
        own = np.repeat(np.arange(to - at), np.diff(a.starts[at:to + 1]))
        terms = spread(b.starts[a.columns[some]], sizes[some])
        parts.append(gather(np.repeat(own, sizes[some]), b.columns[terms], np.repeat(a.values[some], sizes[some]) * b.values[terms], to - at))
        at = to
    if not parts:
        return Csr(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    lengths = np.concatenate([np.diff(p.starts) for p in parts])
    return Csr(np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([p.columns for p in parts]), np.concatenate([p.values for p in parts]))
