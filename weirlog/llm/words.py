"""Words of a text as bytes, and hashes of word sequences."""

from __future__ import annotations

import string

import numpy as np
import xxhash

# Lower-cased A-Z, digits and everything beyond ASCII make words; the rest of ASCII parts them.
_KEPT = (string.digits + string.ascii_lowercase).encode() + bytes(range(128, 256))
_TABLE = bytes(
    b + 32 if chr(b) in string.ascii_uppercase else b if b in _KEPT else 32 for b in range(256)
)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def gram_hashes(found: list[bytes], k: int) -> np.ndarray:
    """A 64-bit hash of every ``k`` consecutive words, as signed integers; never 0."""
    n = len(found) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    single = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _FACTOR + single[i : i + n]
    out ^= out >> np.uint64(29)
    out *= _FACTOR
    out ^= out >> np.uint64(32)
    return np.where(out == 0, np.uint64(1), out).view(np.int64)
