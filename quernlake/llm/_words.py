"""Hashes of words and of runs of words."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import xxhash


def mix(h: np.ndarray) -> np.ndarray:
    """A mixing of 64 bits; different values stay different."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Vocabulary:
    """Two 64-bit hashes of each word's bytes, from different families: XXH3 and BLAKE2b.

    Remembers up to ``limit`` words and those of one text; beyond, it begins anew.
    """

    def __init__(self, limit: int = 300_000):
        self.limit = limit
        self._begin()

    def _begin(self) -> None:
        self.place: dict[bytes, int] = {}
        self.first, self.second = np.zeros(1024, "uint64"), np.zeros(1024, "uint64")

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of each of ``words``."""
        at = list(map(self.place.get, words))
        if None in at:
            if len(self.place) > self.limit:
                self._begin()
            fresh = list({w for w in words if w not in self.place})
            n = len(self.place)
            while len(self.first) < n + len(fresh):
                self.first, self.second = (np.concatenate([x, np.zeros(len(x), "uint64")]) for x in (self.first, self.second))
            self.place.update(zip(fresh, range(n, n + len(fresh))))
            self.first[n : n + len(fresh)] = list(map(xxhash.xxh3_64_intdigest, fresh))
            self.second[n : n + len(fresh)] = np.frombuffer(b"".join([blake2b(w, digest_size=8).digest() for w in fresh]), "uint64")
            at = list(map(self.place.__getitem__, words))
        at = np.array(at, "int64")
        return self.first[at], self.second[at]


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words, by the words' hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, "uint64")
    out = h[:m] + np.uint64(0x9E3779B97F4A7C15 ^ n)
    for k in range(1, n):
        out ^= out >> np.uint64(32)
        out *= np.uint64(0x9FB21C651E98DF25)
        out += h[k : k + m]
    return mix(out)
