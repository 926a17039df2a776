"""Word shingles and minwise tokens of whole texts, in numpy over batches of documents."""

from __future__ import annotations

import hashlib

import numpy as np

#: White space that parts words; all other bytes belong to words.
GAPS = np.zeros(256, bool)
GAPS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20240501)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word, A-Z lower-cased, in text order."""
    raw = np.frombuffer(data, np.uint8)
    gap = GAPS[raw]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.uint64)
    # Each byte's hash depends on its place in the word; a word's is the mix of their sum.
    place = np.arange(len(raw), dtype=np.int64)
    offset = place - np.repeat(starts, np.diff(np.append(starts, len(raw))))[: len(raw)] if starts[0] == 0 else \
        place - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(raw)]])))
    each = mixed(BYTE[LOWER[raw]] + offset.astype(np.uint64) * STEP)
    each[gap] = 0
    return mixed(np.add.reduceat(each, starts) + (ends - starts).astype(np.uint64))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; fewer words are one run; none give none."""
    if not len(words):
        return words
    n = min(size, len(words))
    runs = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        runs = mixed(runs * STEP + words[k:len(words) - n + 1 + k])
    # A short text must not equal a run of another's.
    return np.unique(runs if n == size else mixed(runs + np.uint64(n)))


def minwise(tokens: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The smallest 32-bit hash of the set under every seed."""
    out = np.full(len(seeds), np.uint32(0xFFFFFFFF))
    for start in range(0, len(tokens), 2048):
        part = tokens[start:start + 2048, None] * seeds[None, :]
        part ^= part >> np.uint64(29)
        part *= MIX[1]
        np.minimum(out, (part >> np.uint64(32)).astype(np.uint32).min(axis=0), out=out)
    return out


def seeds_of(count: int) -> np.ndarray:
    return np.random.default_rng(77).integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(a) else 0


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)
