"""Words of many texts at once, as flat arrays: where they start, how long they are, 64-bit hashes of them."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20_240_611)
#: A random number for each byte, and an odd base: the hash is a polynomial modulo 2^64 over them, then mixed.
BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)

#: Anything but ASCII white space.
SOLID = np.ones(256, dtype=bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False
#: ASCII letters and all of what is not ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
#: A-Z to a-z, the rest as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), BASE)], dtype=np.uint64)


def words(raw: np.ndarray, at: np.ndarray, inside: np.ndarray = SOLID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text number of every word (a run of bytes that are `inside`, within one text)."""
    w = inside[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[at] = True
    starts = np.flatnonzero(w & (edge[:-1] | ~np.r_[False, w[:-1]]))
    ends = np.flatnonzero(w & (edge[1:] | ~np.r_[w[1:], False])) if len(raw) else starts
    return starts, ends - starts + 1, np.searchsorted(at, starts, side="right") - 1


def hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    ends = np.cumsum(lengths)
    inner = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
    parts = BYTES[raw[np.repeat(starts, lengths) + inner]] * powers(int(lengths.max()))[inner]
    return mix(np.add.reduceat(parts, ends - lengths) + lengths.astype(np.uint64))


def prefixes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, shortest: int, longest: int):
    """For each size: which words are at least so long, and a hash of so many first bytes of those."""
    own, total = np.arange(len(starts)), np.zeros(len(starts), dtype=np.uint64)
    power = powers(longest)
    for k in range(longest):
        keep = lengths[own] > k
        own, total = own[keep], total[keep]
        total = total + BYTES[raw[starts[own] + k]] * power[k]
        if k + 1 >= shortest:
            yield k + 1, own, mix(total ^ np.uint64((k + 1) * 0x51ED2701))
