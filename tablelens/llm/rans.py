"""Interleaved range asymmetric numeral system over numpy arrays.

A segment is a run of token ids with one frequency table, shared by its blocks. A block holds LANES x ROWS ids, id i of
a block in lane i mod LANES, and is independent of all others. Per block there are CHECKPOINTS states of all lanes, with
their place in the block's words, so that each part of each block can be decoded by itself; here all are decoded side by
side as one array. The tail of the last block is filled up with the most frequent id.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, ROWS, CHECKPOINTS = 64, 256, 2
SCALE = 20  # bits of the frequencies' sum
LOW = np.uint64(1 << 31)  # states stay in [LOW, LOW << 32)
MAGIC = b"RNS1"
HEADER = struct.Struct("<4sQIIII")  # magic, ids, symbols, blocks, words, checksum of the rest

_U = np.uint64


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts above zero as frequencies of at least one with the sum 2 ** SCALE."""
    total = 1 << SCALE
    if len(counts) > total:
        raise ValueError("more symbols than the frequency table can hold")
    freq = np.maximum(1, (counts.astype(np.float64) * (total / counts.sum())).astype(np.int64))
    over = int(freq.sum()) - total
    largest = np.argsort(-freq, kind="stable")
    if over <= 0:
        freq[largest[0]] -= over
    else:
        spare = freq[largest] - 1
        taken = np.minimum(spare, np.maximum(0, over - (np.cumsum(spare) - spare)))
        freq[largest] -= taken
    return freq


def encode(ids: np.ndarray) -> bytes:
    """A segment of at least one id (unsigned 32 bit)."""
    symbols, inverse, counts = _symbols(ids)
    freq = frequencies(counts)
    starts = np.cumsum(freq) - freq
    size = LANES * ROWS
    n_blocks = -(-len(ids) // size)
    full = np.full(n_blocks * size, np.argmax(freq), inverse.dtype)
    full[:len(ids)] = inverse
    full = full.reshape(n_blocks, ROWS, LANES)
    freq64, start64 = freq.astype(_U), starts.astype(_U)
    state = np.full((n_blocks, LANES), LOW, _U)
    out = np.empty((n_blocks, ROWS, LANES), np.uint32)
    mask = np.empty((n_blocks, ROWS, LANES), bool)
    every = ROWS // CHECKPOINTS
    saved = np.empty((n_blocks, CHECKPOINTS, LANES), _U)
    for t in range(ROWS - 1, -1, -1):
        sym = full[:, t, :]
        f = freq64[sym]
        spill = state >= (f << _U(63 - SCALE))
        mask[:, t, :] = spill
        out[:, t, :] = state & _U(0xFFFFFFFF)
        state = np.where(spill, state >> _U(32), state)
        whole = state // f
        state = (whole << _U(SCALE)) + (state - whole * f) + start64[sym]
        if t % every == 0:
            saved[:, t // every, :] = state
    words = out[mask]
    per_part = mask.reshape(n_blocks, CHECKPOINTS, -1).sum(axis=2)
    places = (np.cumsum(per_part) - per_part.ravel()).astype("<u8")
    body = zlib.compress(symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 1)
    body = struct.pack("<I", len(body)) + body + places.tobytes() + saved.astype("<u8").tobytes() + words.astype("<u4").tobytes()
    return HEADER.pack(MAGIC, len(ids), len(symbols), n_blocks, len(words), zlib.crc32(body)) + body


def decode(segment: bytes) -> np.ndarray:
    magic, n, n_symbols, n_blocks, n_words, check = HEADER.unpack_from(segment)
    body = memoryview(segment)[HEADER.size:]
    if magic != MAGIC or zlib.crc32(body) != check:
        raise ValueError("damaged segment")
    (table_size,) = struct.unpack_from("<I", body)
    table = np.frombuffer(zlib.decompress(body[4:4 + table_size]), "<u4")
    symbols, freq = table[:n_symbols], table[n_symbols:].astype(_U)
    starts = np.cumsum(freq) - freq
    parts, at = n_blocks * CHECKPOINTS, 4 + table_size
    place = np.frombuffer(body, "<u8", parts, at).astype(np.int64)
    state = np.frombuffer(body, "<u8", parts * LANES, at + 8 * parts).reshape(parts, LANES).astype(_U)
    words = np.frombuffer(body, "<u4", n_words, at + 8 * parts * (1 + LANES)).astype(_U)
    words = np.append(words, _U(0))  # what a lane that reads nothing points at
    look_up = np.repeat(np.arange(n_symbols, dtype=np.uint32), freq.astype(np.int64))
    every = ROWS // CHECKPOINTS
    out = np.empty((parts, every, LANES), np.uint32)
    low_bits = _U((1 << SCALE) - 1)
    for t in range(every):
        slot = state & low_bits
        sym = look_up[slot]
        out[:, t, :] = symbols[sym]
        state = freq[sym] * (state >> _U(SCALE)) + slot - starts[sym]
        need = state < LOW
        upto = np.cumsum(need, axis=1)
        index = np.where(need, place[:, None] + upto - 1, n_words)
        state = np.where(need, (state << _U(32)) | words[index], state)
        place = place + upto[:, -1]
    return out.ravel()[:n]


def _symbols(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, the number of each id among them, and their counts."""
    if int(ids.max()) < 1 << 20:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        number = np.zeros(len(counts), np.uint32)
        number[symbols] = np.arange(len(symbols), dtype=np.uint32)
        return symbols, number[ids], counts[symbols]
    symbols, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
    return symbols, inverse.astype(np.uint32), counts
