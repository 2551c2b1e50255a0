"""Vectorised scanning of words over Arrow text columns (runs inside tasks).

A word is a maximal run of bytes other than space and \\t..\\r, so words are
those of ``[^\\x20\\x09-\\x0D]+``.  Text columns are taken in slices of whole
rows; per-byte arrays exist for one bounded piece at a time, so memory follows
the number of words of the longest text, not a multiple of its bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
_PIECE = 1 << 18
_U = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_NEXT_SEP = re.compile(rb"[\x09-\x0d ]")
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _byte_values(lower: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
    if lower:
        t[65:91] = t[97:123]
    return t


_VALUES = {False: _byte_values(False), True: _byte_values(True)}
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    t = _powers.get(base)
    if t is None or len(t) < n:
        t = np.full(max(n, 2 * _PIECE), _U(base))
        t[0] = 1
        t = np.cumprod(t, dtype=np.uint64)
        if n <= 8 * _PIECE:
            _powers[base] = t
    return t[:n]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls become empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offs


def slices(col: pa.Array, size: int = SLICE_BYTES):
    """(first row, bytes, offsets from 0) of runs of rows of about ``size`` bytes."""
    data, offs = buffers(col)
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + size, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def _scan(data, offs, lower):
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e, np.zeros(0, np.uint64)
    sep = _SEP[data]
    word = ~sep
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = word.copy()
    first[1:] &= sep[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= sep[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return start, start, end, np.zeros(0, np.uint64)
    doc = np.searchsorted(offs, start, side="right") - 1
    value = _VALUES[lower][data]
    value *= _power(_BASE, n)
    value[sep] = 0
    h = np.add.reduceat(value, start)
    h *= _power(_BASE_INVERSE, n)[start]
    return doc, start, end, mix(h + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def scan(data: np.ndarray, offs: np.ndarray, lower: bool = False):
    """Row, byte start, byte end and 64-bit hash of every word, in order.

    ``lower``: words equal but for A-Z against a-z get the same hash.
    """
    n, cuts = len(data), [0]
    while n - cuts[-1] > 2 * _PIECE:
        found = _NEXT_SEP.search(data, cuts[-1] + _PIECE)
        if not found:
            break
        cuts.append(found.start())
    if len(cuts) == 1:
        return _scan(data, offs, lower)
    parts = []
    for a, b in zip(cuts, cuts[1:] + [n]):
        doc, start, end, h = _scan(data[a:b], np.clip(offs, a, b) - a, lower)
        parts.append((doc, start + a, end + a, h))
    return tuple(np.concatenate(x) for x in zip(*parts))


def grams(h: np.ndarray, doc: np.ndarray, k: int, base: int = _BASE):
    """Hashes of ``k`` consecutive words and which of them stay in one row.

    Another (odd) ``base`` gives a second hash of the same words.
    """
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    g = h[:m].copy()
    for j in range(1, k):
        g *= _U(base)
        g += h[j:j + m]
    return mix(g), doc[:m] == doc[k - 1:]


def spans(doc: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each of ``n`` rows in a sorted row-number array."""
    return np.searchsorted(doc, np.arange(n + 1))


def struct_of(n: int, **columns) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(v) if not isinstance(v, pa.Array) else v for v in columns.values()],
                                      names=list(columns))
