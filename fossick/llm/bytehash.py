"""Vectorised hashes of words, word windows and character shingles, straight from the UTF-8 bytes of an Arrow column.

A prefix sum of ``T[byte] * B**position`` modulo 2**64 gives the polynomial hash of any span by one subtraction and one
multiplication with ``B**-start`` (``B`` is odd, so the inverse exists); a final mix spreads the bits.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASES = (_BASE, 0xD1B54A32D192ED03 | 1)
_TABLES = [np.random.Generator(np.random.PCG64(s)).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1) for s in (11, 23)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``B**i`` and ``B**-i`` for i < n, kept for the next call."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        base = _BASES[which]
        inv = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inv):
            p = np.empty(size, np.uint64)
            p[0] = 1
            k = 1
            while k < size:  # doubling: p[k:2k] = p[:k] * b**k
                p[k : 2 * k] = p[:k] * _U(pow(b, k, 1 << 64))
                k *= 2
            both.append(p)
        _powers[which] = have = (both[0], both[1])
    return have[0][:n], have[1][:n]


def forget() -> None:
    """Drops the powers that were kept: some megabytes, made again in milliseconds."""
    _powers.clear()


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of ``values[start:end]`` for every span; equal runs have equal hashes wherever they stand."""
    up, down = powers(len(values) + 1, which)
    p = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=p[1:])
    return mix((p[ends] - p[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and n+1 offsets of the texts into the words.

    A word is a maximal run of bytes that aren't ASCII white space.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~_SPACE[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = ~solid[:-1]
    first[offs[:-1][offs[:-1] < len(data)]] = True
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = ~solid[1:]
    inner = offs[1:]
    last[inner[inner > 0] - 1] = True
    starts = np.flatnonzero(solid & first)
    ends = np.flatnonzero(solid & last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return spans_hash(_TABLES[which][data], starts, ends, which)


def distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers of ``x``, sorted. Sorting beats the hash table of ``np.unique`` several times."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``concatenate([arange(s, s + c) for s, c in zip(starts, counts)])``."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = counts > 0
    starts, counts = starts[keep], counts[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    at = np.cumsum(counts)[:-1]
    step[at] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
    return np.cumsum(step)
