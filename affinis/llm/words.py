"""Word and shingle hashing shared by the text operators (worker side, NumPy)."""

from __future__ import annotations

import numpy as np
import xxhash

#: Entries after which a worker's word cache is emptied: a memory bound, results do not depend on it.
CACHE_WORDS = 100_000

_ROT = np.uint64(29)
_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hashes of byte words, kept for words met before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes, ascending, of all runs of ``width`` words; a shorter text is one shingle as a whole."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(width, n)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = mix(((out << _ROT) | (out >> (np.uint64(64) - _ROT))) * _M1 + hashes[i : n - size + 1 + i])
    return np.unique(out)
