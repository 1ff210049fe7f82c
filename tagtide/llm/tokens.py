"""Vectorised tokenising and hashing of Arrow string columns, for the operators that run Python.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Every word gets a 64-bit hash: the
sum of a random number per byte value times a power per position, mixed. Only numpy touches the
bytes; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE = _RNG.integers(1, 2**64, 256, dtype=U) | U(1)
BYTE_FOLDED = BYTE.copy()
BYTE_FOLDED[65:91] = BYTE[97:123]
STEP = U(0x9E3779B97F4A7C15)
PLACE = _RNG.integers(1, 2**64, 64, dtype=U) | U(1)
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), STEP, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about `size` bytes each, one document at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j
        i = j


def word_hashes(buf: np.ndarray, off: np.ndarray, folded: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and where each document's words begin (one entry more than documents)."""
    if not len(buf):
        return np.zeros(0, U), np.zeros(len(off), np.int64)
    inside = ~SPACES[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, U), np.zeros(len(off), np.int64)
    lens = ends - starts
    base = np.cumsum(lens) - lens
    chars = buf[inside]
    place = np.arange(len(chars)) - np.repeat(base, lens)
    h = np.add.reduceat((BYTE_FOLDED if folded else BYTE)[chars] * powers(int(lens.max()))[place], base)
    return mix(h + lens.astype(U)), np.searchsorted(starts, off)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by its first word; runs over a document's end are included."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out += h[j : j + n] * (PLACE[j % 64] + U(2 * (j // 64)))
    return mix(out)


def sequence_hash(h: np.ndarray) -> U:
    """Hash of a whole word sequence of any length, also as a short document's only shingle."""
    if not len(h):
        return U(0)
    with np.errstate(over="ignore"):
        return mix(np.array([(h * powers(len(h))).sum(dtype=U) + U(len(h))], U))[0]


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of each run of k words, from prefix sums: its cost does not grow with k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    inverse = U(pow(int(STEP), -1, 2**64))
    p = powers(len(h))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(h * p, dtype=U)])
    back = np.full(n, inverse, U)
    back[0] = 1
    return mix((sums[k:] - sums[:-k]) * np.cumprod(back, dtype=U))
