"""Vectorised words, hashes and shingles over Arrow string columns.

Texts stay in the Arrow buffer: a batch is cut into slices of about a quarter
of a megabyte, and words are hashed from prefix sums of a polynomial in the bytes,
so no Python object is made for a word or a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A-Z lower-cased and every other ASCII character that is no letter or digit made a space.
PLAIN = LOWER.copy()
PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32


def plain(part: np.ndarray) -> np.ndarray:
    """``PLAIN``, and the Latin-1 capitals of two-byte UTF-8 lower-cased too."""
    out = PLAIN[part]
    after = np.flatnonzero(part[:-1] == 0xC3) + 1
    after = after[(out[after] >= 0x80) & (out[after] <= 0x9E) & (out[after] != 0x97)]
    out[after] += 32
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for i, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which is faster here than ``np.unique``'s hashing."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes together; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """Words of rows ``lo:hi``: 64-bit hash, byte start and end, and the first word of each row."""

    lo: int
    hi: int
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    raw: np.ndarray


def words(column: pa.Array, marks: bool = True) -> Iterator[Words]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row, A-Z lower-cased; without ``marks``, runs of letters and digits."""
    raw, offsets = utf8(column)
    for lo, hi in slices(offsets):
        part, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        part = LOWER[part] if marks else plain(part)
        solid = ~SPACE[part]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        heads = at[:-1][at[:-1] < len(part)]
        begins[heads] = solid[heads]  # a row's first byte begins a word of its own
        start = np.flatnonzero(begins)
        stops = np.zeros(len(part) + 1, bool)
        stops[1:-1] = solid[:-1] & ~solid[1:]
        inner = at[1:-1]
        inner = inner[(inner > 0) & (inner < len(part))]
        stops[inner] |= solid[inner - 1]
        if len(part):
            stops[-1] = solid[-1]
        end = np.flatnonzero(stops)
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        yield Words(lo, hi, h, start, end, np.searchsorted(start, at, "left"), part)


_STEP = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], np.uint64)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbouring word hashes (over row ends too)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * _STEP[k]
    return mix(out)


def shingle_sets(w: Words, n: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct ``n``-word shingles; fewer words count as one shingle, none as none."""
    runs = grams(w.hash, n)
    for i in range(w.hi - w.lo):
        a, b = w.first[i], w.first[i + 1]
        if b - a >= n:
            yield w.lo + i, distinct(runs[a : b - n + 1])
        elif b > a:
            short = (w.hash[a:b] * _STEP[n : n + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield w.lo + i, mix(np.array([short], np.uint64))
        else:
            yield w.lo + i, np.zeros(0, np.uint64)
