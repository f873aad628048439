"""Word shingles as 64-bit hashes, and minwise sketches of them (numpy, one text at a time)."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

from .common import words

WIDTH = 5
SKETCH = 128
_M = np.uint64(0x9E3779B97F4A7C15)
_R = np.random.default_rng(20240501)
_A = (_R.integers(0, 2 ** 31, SKETCH, dtype=np.uint64) * 2 + 1).astype(np.uint32)[:, None]
_B = _R.integers(0, 2 ** 32, SKETCH, dtype=np.uint64).astype(np.uint32)[:, None]


class WordHashes(dict):
    """64-bit hash of each word, remembered up to ``limit`` words (speed only)."""

    limit = 50_000

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh64_intdigest(w)
        if len(w) <= 64:
            self[w] = h
        return h


_HASHES = WordHashes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; under five words the whole sequence is one; empty without words."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.array([_HASHES[x] for x in w], np.uint64)
    n = max(1, len(h) - WIDTH + 1)
    g = np.full(n, min(len(h), WIDTH), np.uint64)
    for k in range(min(WIDTH, len(h))):
        g = (g ^ h[k:k + n]) * _M
        g ^= g >> np.uint64(29)
    return np.unique(g)


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit halves of a digest of the whole set."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH minima (uint32) of independent permutations of the set's hashes."""
    low = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    u = (s >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(u), 4096):
        low = np.minimum(low, (u[a:a + 4096][None] * _A + _B).min(1))
    return low
