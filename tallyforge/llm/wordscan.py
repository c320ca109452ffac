"""Words of a text as 64-bit hashes, found and hashed by whole-array operations."""

from __future__ import annotations

import numpy as np
import xxhash

_CHUNK = 1 << 18
#: Longer words are hashed one by one.
_LONG = 1 << 16
_STEP = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(_CHUNK + _LONG, base, np.uint64))))


_POW, _INVERSE = _powers(_STEP), _powers(pow(_STEP, -1, 1 << 64))


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finisher)."""
    h = h + np.uint64(seed * _STEP % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(data: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that ``is_word`` (256 flags) holds for."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = is_word[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span; equal bytes have equal hashes wherever they stand."""
    out = np.zeros(len(starts), np.uint64)
    long = ends - starts > _LONG
    raw = np.frombuffer(data, np.uint8)
    at = 0
    while at < len(starts):
        if long[at]:
            out[at] = xxhash.xxh64_intdigest(data[starts[at]:ends[at]], 1)
            at += 1
            continue
        base = starts[at]
        upto = int(np.searchsorted(starts, base + _CHUNK))
        if long[at:upto].any():
            upto = at + int(long[at:upto].argmax())
        size = int(ends[upto - 1] - base)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((raw[base:base + size] + np.uint64(1)) * _POW[:size], out=sums[1:])
        s, e = starts[at:upto] - base, ends[at:upto] - base
        out[at:upto] = mix((sums[e] - sums[s]) * _INVERSE[s] + (e - s).astype(np.uint64))
        at = upto
    return out


def windows(hashed: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive words, from the words' hashes."""
    n = len(hashed) - width + 1
    out = np.zeros(max(0, n), np.uint64)
    for at in range(0, n, _CHUNK):
        part = hashed[at:at + _CHUNK + width - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _POW[:len(part)], out=sums[1:])
        size = len(part) - width + 1
        out[at:at + size] = mix((sums[width:] - sums[:size]) * _INVERSE[:size])
    return out
