"""Hashes of words and of word shingles, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from cadenza.llm.common import words

U64 = np.uint64


class WordHashes(dict):
    """64-bit hashes of words, filled as words come."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:  # bounds memory; a word gets the same hash again
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(known.__getitem__, found), U64, len(found))


def odd(n: int, seed: int) -> np.ndarray:
    """n odd random multipliers."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def windows(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A hash of each k consecutive word hashes; none if there are fewer."""
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for i, m in enumerate(odd(k, seed)):
        out += h[i : i + n] * m
    return mixed(out)


def shingle_set(h: np.ndarray, k: int = 5) -> np.ndarray:
    """The distinct k-word shingles, ascending; a text of 1 to k - 1 words has one, of all its words."""
    if 0 < len(h) < k:
        return windows(h, len(h), 100 + len(h))
    return np.unique(windows(h, k, 100 + k))
