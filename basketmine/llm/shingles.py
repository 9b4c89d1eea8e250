"""Hashed word-shingle sets of texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from basketmine.llm.common import WordHash, words_of

WORDS = 5                 # words of a shingle
# Odd multipliers that tie a word's hash to its place in the shingle.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                    0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(data: bytes | None, cache: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; a shorter text is one shingle, no word none."""
    words = words_of(data or b"")
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    k = min(n, WORDS)
    out = np.full(n - k + 1, k, np.uint64)      # texts of fewer words hash apart
    for i in range(k):
        out += mix(h[i:n - k + 1 + i]) * _PLACES[i]
    return np.unique(mix(out))


def set_id(s: np.ndarray) -> int:
    """Signed 64-bit id of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))
