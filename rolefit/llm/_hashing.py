"""Vectorised 64-bit hashes of words, shingles and byte windows.

A polynomial hash modulo 2**64 of every prefix gives the hash of any substring by one subtraction;
a finaliser then mixes the bits. Byte values are replaced by fixed random 64-bit numbers first.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def table(seed: int, fold_case: bool = False) -> np.ndarray:
    """256 fixed random numbers, A-Z as a-z if `fold_case`."""
    t = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))
    if fold_case:
        t[65:91] = t[97:123]
    return t


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(np.concatenate([[U(1)], np.full(size - 1, base, U)]))
        _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] times `unshift(i)` being the hash of data[i:j]."""
    p = np.empty(len(data) + 1, U)
    p[0] = 0
    np.cumsum(values[data] * powers(_BASE, len(data)), out=p[1:])
    return p


def unshift(n: int) -> np.ndarray:
    return powers(_INVERSE, n)


#: Bytes of a word from which on it is hashed by BLAKE2b: modulo 2**64 some patterned strings of several hundred bytes have one polynomial hash.
LONG_WORD = 64


def word_hashes(data: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the runs of bytes other than ASCII white space."""
    edge = np.diff(np.concatenate([[0], (~WHITE[data]).view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    p = prefix_hash(data, values)
    hashes = mix((p[ends] - p[starts]) * unshift(len(data) + 1)[starts] + (ends - starts).astype(U))
    for k in np.flatnonzero(ends - starts >= LONG_WORD).tolist():
        word = data[starts[k] : ends[k]].tobytes()
        hashes[k] = int.from_bytes(blake2b(word.lower() if values[65] == values[97] else word, digest_size=8).digest(), "little")
    return starts, ends, hashes


def sequence_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, U)
    total = np.full(n, U(size * 0xD6E8FEB86659FD93 % (1 << 64)), U)
    for k in range(size):
        total = mix(total + words[k : k + n])
    return total


def shingle_sets(data: np.ndarray, offsets: np.ndarray, values: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row its sorted distinct shingle hashes: runs of `size` words; all words as one if there are fewer; empty without words."""
    starts, _, words = word_hashes(data, values)
    bounds = np.searchsorted(starts, offsets)
    runs = sequence_hash(words, size)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            sets.append(np.unique(runs[a : b - size + 1]))
        else:
            sets.append(sequence_hash(words[a:b], b - a) if b > a else np.empty(0, U))
    return sets
