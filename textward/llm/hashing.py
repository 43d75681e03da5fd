"""Vectorised hashes of words and word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

#: A-Z to a-z; the six white-space bytes to a space.
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
#: Words that a worker remembers before it forgets them all.
REMEMBERED = 200_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class WordHash(dict):
    """Word to a signed 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h = h - (1 << 64) if h >> 63 else h
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, memo: WordHash, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; of the whole sequence if it has fewer words, but some."""
    ws = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not ws:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(memo.__getitem__, ws), np.int64, len(ws)).view(np.uint64)
    k = min(k, len(w))
    n = len(w) - k + 1
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = out * _ODD[j] + w[j : j + n]
    return np.unique(mix(out))
