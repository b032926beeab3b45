"""Words, shingles and their hashes, computed inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
SHIFT = np.uint64(32)


class WordHashes(dict):
    """64-bit hash of a word's bytes, remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, cut at space and the five ASCII controls
    from tab to carriage return. Null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> SHIFT)) * MULTIPLIER
    x = (x ^ (x >> SHIFT)) * MULTIPLIER
    return x ^ (x >> SHIFT)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles. A text with one to k-1
    words has one shingle, the whole word sequence; a text without words has none."""
    h = word_hashes(lower_words(text))
    if len(h) == 0:
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    acc = mixed(h[:n] + np.uint64(k))
    for j in range(1, k):
        acc = mixed(acc * np.uint64(31) + h[j : j + n])
    return np.unique(acc)
