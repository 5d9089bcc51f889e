"""Words of texts as 64-bit numbers, for the operators that count or compare word sequences."""

from __future__ import annotations

import numpy as np
import xxhash

M1, M2, M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> M3
    x *= M1
    x ^= x >> M3
    x *= M2
    x ^= x >> M3
    return x


class Hashes(dict):
    """word (bytes) -> 64-bit hash; words seen lately are kept."""

    MOST = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def lower_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case (bytes.lower and bytes.split know ASCII alone)."""
    return text.encode().lower().split() if text else []


def word_hashes(words: list[bytes], known: Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of the runs of `width` words, sorted; with fewer words, of the whole sequence."""
    if not len(h):
        return h
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out + h[i : len(h) - n + 1 + i])
    return np.unique(out)
