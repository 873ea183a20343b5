"""64-bit hashes of words and shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: all but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words: ASCII letters and digits, and all bytes of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[128:] = ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True


_known: dict[int, np.ndarray] = {}


#: Powers that a worker keeps; longer texts make theirs anew.
_KEPT = 1 << 21


def _powers(n: int, base: int) -> np.ndarray:
    """At least the first ``n`` powers; one array of bounded length is kept for each base."""
    if len(known := _known.get(base, ())) >= n:
        return known
    out = np.full(1 << max(16, (n - 1).bit_length()), base, np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    if len(out) <= _KEPT:
        _known[base] = out
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """uint64 hash of each data[start:end]: a polynomial over the bytes and the length, mixed."""
    sums = _sums(data)
    back = _powers(len(data) + 1, pow(_BASE, -1, 1 << 64))
    return mix((sums[ends] - sums[starts]) * back[starts] ^ (ends - starts).astype(np.uint64) << np.uint64(48))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """range_hashes() of every run of ``size`` bytes."""
    sums = _sums(data)
    out = sums[size:] - sums[:-size]
    out *= _powers(len(data) + 1, pow(_BASE, -1, 1 << 64))[: len(out)]
    out ^= np.uint64(size) << np.uint64(48)
    return mix(out)


def _sums(data: np.ndarray) -> np.ndarray:
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= _powers(len(data) + 1, _BASE)[: len(data)]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    return sums


def words(texts: list[bytes], of: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets: text i has hashes[offsets[i]:offsets[i + 1]]); A-Z count as a-z."""
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = of[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    starts, ends = edges[::2], edges[1::2]
    stops = np.cumsum([len(t) + 1 for t in texts])
    return range_hashes(data, starts, ends), np.concatenate([[0], np.searchsorted(starts, stops)])


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; of the whole sequence if it is shorter; none without words."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    out = np.full(len(hashes) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : len(hashes) - size + 1 + k])
    return out


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    hashes, offsets = words(texts)
    if len(hashes) < size:
        return [np.unique(shingles(hashes[a:b], size)) for a, b in zip(offsets, offsets[1:], strict=False)]
    every = shingles(hashes, size)
    out = []
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        if b - a >= size:
            x = np.sort(every[a : b - size + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        else:
            out.append(np.unique(shingles(hashes[a:b], size)))
    return out
