"""Texts of an Arrow batch as numpy arrays: bytes, characters, word and shingle hashes.

Everything here works on whole batches; no per-word Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_FACTOR = 0x9E3779B97F4A7C15
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_S1, _S2, _S3 = U64(30), U64(27), U64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> _S1)) * _M1
    x = (x ^ (x >> _S2)) * _M2
    return x ^ (x >> _S3)


#: One 64-bit value per byte, and the map of A-Z to a-z on bytes.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(_FACTOR))
BYTE_LOWER = np.arange(256, dtype=np.uint8)
BYTE_LOWER[65:91] += 32
#: [\x20\x09-\x0D]
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
_kept: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0 .. n-1 of the rolling factor, or of its inverse modulo 2**64."""
    base = pow(_FACTOR, -1, 1 << 64) if inverse else _FACTOR
    if base not in _kept or len(_kept[base]) < n:
        p = np.full(max(n, 1 << 20), base, U64)
        p[0] = 1
        _kept[base] = np.multiply.accumulate(p)
    return _kept[base][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def pieces(offsets: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes together; a longer text stands alone."""
    out, first, n = [], 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(first + 1, last))
        out.append((first, last))
        first = last
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and their number) of words ``[^\\x20\\x09-\\x0D]+``."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~IS_BLANK[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    borders = offsets[1:-1]
    borders = borders[borders < n]
    begin[borders] = word[borders]
    end = word.copy()
    end[:-1] &= ~word[1:]
    inner = borders[borders > 0]
    end[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of every word, A-Z lower-cased."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    n = len(data)
    p = powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(BYTE_VALUE[BYTE_LOWER[data]] * p[:n], out=total[1:])
    # the sum over the word, without the power of its place in the batch
    return mix((total[ends] - total[starts]) * powers(n + 1, inverse=True)[starts] + (ends - starts).astype(U64) * _M1)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of ``size`` words; a shorter text is one run."""
    n = len(words)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    runs = np.zeros(max(0, n - size + 1), U64)
    factor = U64(_FACTOR)
    for k in range(size if len(runs) else 0):
        runs = mix(runs * factor + words[k:n - size + 1 + k])
    owner = np.repeat(np.arange(len(counts)), np.maximum(counts - size + 1, 0))
    at = first[:-1][owner] + (np.arange(len(owner)) - np.repeat(
        np.cumsum(np.maximum(counts - size + 1, 0)) - np.maximum(counts - size + 1, 0), np.maximum(counts - size + 1, 0)))
    hashes = runs[at] if len(at) else np.zeros(0, U64)
    if len(short):
        extra = np.zeros(len(short), U64)
        for j, t in enumerate(short):
            value = U64(counts[t])
            with np.errstate(over="ignore"):
                for w in words[first[t]:first[t + 1]]:
                    value = mix(np.array([value * factor + w], U64))[0]
            extra[j] = value
        hashes, owner = np.concatenate([hashes, extra]), np.concatenate([owner, short])
    return hashes, owner


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets in code points)."""
    if len(data) == 0:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return points, before[offsets]
