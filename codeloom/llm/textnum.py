"""Vectorised work on the bytes of many texts at once.

A batch of texts is one buffer of UTF-8 bytes and an array of offsets. Nothing
here loops over words: hashes of words, shingles and windows come from prefix
sums of powers of an odd base, modulo 2^64.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_POWERS = np.ones(1, dtype=U)
_NEGATIVE = np.ones(1, dtype=U)

_rng = np.random.default_rng(20240501)
#: A random value for each byte, and for each byte after A-Z became a-z.
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
_low = np.arange(256)
_low[65:91] += 32
LOWER = _low.astype(np.uint8)
BYTE_VALUE_LOWER = BYTE_VALUE[LOWER]
#: The white space that ends words: space, tab, newline, vertical tab, form feed, return.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def trim() -> None:
    """Give freed memory back to the system, as a worker process stays for later tasks that need other things."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse from 0 to ``n`` at least."""
    global _POWERS, _NEGATIVE
    if len(_POWERS) <= n:
        size = max(n + 1, 1 << 16)
        size = 1 << (size - 1).bit_length()
        for name, b in (("_POWERS", _BASE), ("_NEGATIVE", _INVERSE)):
            p = np.full(size, b, dtype=U)
            p[0] = 1
            globals()[name] = np.multiply.accumulate(p)
    return _POWERS, _NEGATIVE


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    return buf[first : int(offsets[-1])] if len(offsets) else buf, (offsets - first if len(offsets) else np.zeros(1, dtype=np.int64))


def pieces(offsets: np.ndarray, size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes each; a longer text is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True in ``mask``, which never cross a text's bounds."""
    n = len(mask)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = offsets[(offsets > 0) & (offsets < n)]
    start = mask.copy()
    start[1:] &= ~mask[:-1]
    start[inside] = mask[inside]
    end = mask.copy()
    end[:-1] &= ~mask[1:]
    end[inside - 1] = mask[inside - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``values``, which depends on its content only."""
    pos, neg = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * pos[: len(values)], out=total[1:])
    return mix64((total[ends] - total[starts]) * neg[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z in lower case) and the bounds of each text's words."""
    starts, ends = spans(~IS_SPACE[buf], offsets)
    return span_hash(BYTE_VALUE_LOWER[buf], starts, ends), np.searchsorted(starts, offsets).astype(np.int64)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words by text, repeats included, and their bounds.

    A text of fewer words, but at least one, has one: its whole sequence.
    """
    counts = np.diff(bounds)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate(([0], np.cumsum(n)))
    text = np.repeat(np.arange(len(counts)), n)
    first = np.arange(out_bounds[-1]) - out_bounds[text] + bounds[text]
    h = np.zeros(len(first), dtype=U)
    length = np.minimum(counts, k)[text]
    whole = length == k
    f = first[whole]
    acc = np.zeros(len(f), dtype=U)
    for j in range(k):
        acc = acc * _BASE + hashes[f + j]
    h[whole] = acc
    for i in np.flatnonzero(~whole):
        x = 0
        for j in range(length[i]):
            x = (x * int(_BASE) + int(hashes[first[i] + j])) & 0xFFFFFFFFFFFFFFFF
        h[i] = U((x + 0x1234567 * int(length[i])) & 0xFFFFFFFFFFFFFFFF)
    return mix64(h), out_bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and without repeats, and their bounds."""
    parts = []
    out = np.zeros(len(bounds), dtype=np.int64)
    for i in range(len(bounds) - 1):
        v = np.sort(values[bounds[i] : bounds[i + 1]])
        if len(v) > 1:
            v = v[np.concatenate(([True], v[1:] != v[:-1]))]
        parts.append(v)
        out[i + 1] = out[i] + len(v)
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=U)), out
