"""Word shingles of whole texts as sorted 64-bit hashes, computed with numpy inside Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

# Odd multipliers of a 64-bit mixer; any odd numbers would do.
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordCodes(dict):
    """64-bit code of a word, remembered; forgets all when it has grown large, so that a task's memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(codes: np.ndarray) -> np.ndarray:
    codes = (codes ^ (codes >> np.uint64(30))) * _MIX
    return codes ^ (codes >> np.uint64(31))


def shingles(text: bytes | None, k: int, codes: WordCodes) -> np.ndarray:
    """Distinct ``k``-word shingles of a text (A-Z lowered), sorted; a shorter text is one shingle, a blank one none."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    c = codes.of(words)
    n = max(1, len(c) - k + 1)
    acc = np.full(n, len(words) if len(c) < k else k, np.uint64)
    for j in range(min(k, len(c))):
        acc = mixed(acc * _STEP + c[j:j + n])
    return np.unique(acc)
