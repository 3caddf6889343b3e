"""Runs of consecutive words as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from pagelattice.llm.words import words

# Odd multipliers for mixing.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_hashes: dict[str, int] = {}


def word_hashes(found: list[str]) -> np.ndarray:
    try:
        return np.array([_hashes[w] for w in found], np.uint64)
    except KeyError:
        if len(_hashes) > 400_000:
            _hashes.clear()
        for w in found:
            if w not in _hashes:
                _hashes[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([_hashes[w] for w in found], np.uint64)


def finish(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX[0]
    return x ^ (x >> np.uint64(29))


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` consecutive words, in order; empty for shorter texts."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # A polynomial in an odd base, so that order counts at any length.
    x = h[:n].copy()
    for i in range(1, size):
        x *= _MIX[1]
        x += h[i : i + n]
    return finish(x)


def shingle_set(text: str, size: int) -> np.ndarray:
    """The sorted distinct run hashes of a text."""
    return np.unique(runs(word_hashes(words(text)), size))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sorted sets; 1 for two empty ones."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    either = len(x) + len(y) - both
    return both / either if either else 1.0
