"""Arrays and lists as compressed binary columns."""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import zstandard


def pack(x) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(x, protocol=5))


def unpack(b: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(b))


def narrow(x: np.ndarray) -> np.ndarray:
    """Unsigned values in the smallest type that holds them all."""
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


def word_buckets(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words)).astype(np.int64) % buckets


def by_bucket(bucket: np.ndarray):
    """(bucket, places) of every bucket, the places in order."""
    order = np.argsort(bucket, kind="stable")
    values, first = np.unique(bucket[order], return_index=True)
    return zip(values.tolist(), np.split(order, first[1:])) if len(values) else ()


def fresh(name: str, taken: list[str]) -> str:
    """``name``, made longer until no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name
