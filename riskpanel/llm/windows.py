"""Polynomial (Rabin-Karp) hashes of word windows, vectorised."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd base of the polynomial; arithmetic is modulo 2**64 over independent 64-bit hashes of the words.
BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` words, by the position where it starts; empty if there are fewer words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, length):
        out *= BASE
        out += words[i:i + n]
    return out


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit, so that high bits can deal values out evenly."""
    x = values ^ (values >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))
