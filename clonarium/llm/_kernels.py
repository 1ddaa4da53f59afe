"""Vectorised text kernels over Arrow string buffers: word cutting and 64-bit hashing without Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one kernel call handles at once; a longer text forms a call of its own.
CHUNK = 2 << 20

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=U)
_BASE = int(_rng.integers(0, 2**63, dtype=U)) * 2 + 1 & (2**64 - 1)
_INVERSE = pow(_BASE, -1, 2**64)
#: Multipliers by place in a window; odd.
_PLACE = _rng.integers(0, 2**63, 64, dtype=U) * U(2) + U(1)

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of them."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        m = max(n, CHUNK + 1)
        up, down = np.full(m, _BASE, U), np.full(m, _INVERSE, U)
        up[0] = down[0] = 1
        made = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
        if m > 8 * CHUNK:  # one huge text: not kept
            return made
        _powers = made
    return _powers


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(data: np.ndarray, at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with at most ``limit`` bytes."""
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def cut_words(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that are not in ``space``; no run crosses rows."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial over random byte codes from prefix sums, then finalised."""
    up, down = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=prefix[1:], dtype=U)
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U))


def shingles(words: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct window hashes, sorted within rows: (row, hash, number by row).

    A row with fewer than ``k`` words has its whole sequence as one window, a row without words none.
    """
    count = np.bincount(row, minlength=rows)
    place = np.cumsum(count) - count
    short = (count > 0) & (count < k)
    out_row, out_hash = [], []
    m = len(words) - k + 1
    if m > 0:
        full = np.flatnonzero(row[:m] == row[k - 1 :])
        h = np.zeros(m, U)
        for j in range(k):
            h += words[j : j + m] * _PLACE[j]
        out_row.append(row[full])
        out_hash.append(mix(h[full], 1))
    if short.any():
        own = np.flatnonzero(short[row])
        part = words[own] * _PLACE[own - place[row[own]]]
        starts = np.flatnonzero(np.r_[True, row[own][1:] != row[own][:-1]])
        out_row.append(row[own][starts])
        out_hash.append(mix(np.add.reduceat(part, starts), 1))
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(rows, np.int64)
    r, h = np.concatenate(out_row), np.concatenate(out_hash)
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    r, h = r[new], h[new]
    return r, h, np.bincount(r, minlength=rows)
