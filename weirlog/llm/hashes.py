"""Spark's ``xxhash64`` and ``hash`` of bigint columns, on arrays of them."""

from __future__ import annotations

import numpy as np

_SEED = 42


def xxhash64(*columns: np.ndarray) -> np.ndarray:
    """As ``F.xxhash64``, unsigned."""
    u = np.uint64
    a, b, c, d, e = map(u, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, k: (x << u(k)) | (x >> u(64 - k))
    h = np.full(len(columns[0]), _SEED, u)
    for x in columns:
        h += e + u(8)
        h ^= turned(x * b, 31) * a
        h = turned(h, 27) * a + d
        h ^= h >> u(33)
        h *= b
        h ^= h >> u(29)
        h *= c
        h ^= h >> u(32)
    return h


def murmur(*columns: np.ndarray) -> np.ndarray:
    """As ``F.hash``, unsigned."""
    u = np.uint32
    turned = lambda x, k: (x << u(k)) | (x >> u(32 - k))
    h = np.full(len(columns[0]), _SEED, u)
    for x in columns:
        for half in (x.astype(u), (x >> np.uint64(32)).astype(u)):
            h ^= turned(half * u(0xCC9E2D51), 15) * u(0x1B873593)
            h = turned(h, 13) * u(5) + u(0xE6546B64)
        h ^= u(8)
        h ^= h >> u(16)
        h *= u(0x85EBCA6B)
        h ^= h >> u(13)
        h *= u(0xC2B2AE35)
        h ^= h >> u(16)
    return h
