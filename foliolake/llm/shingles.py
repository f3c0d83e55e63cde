"""Word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .common import entered, remembers

#: Words whose hashes a worker remembers before it starts afresh.
MEMO = 100_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()
remembers("shingles", _words.clear)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased."""
    return (text or "").encode().lower().split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes (int64) of a text's word shingles; with fewer words, of the whole sequence; without words, none."""
    entered("shingles")
    ws = words(text)
    n = len(ws)
    if not n:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(_words.__getitem__, ws), np.uint64, n)
    k = min(n, size)
    h = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        h += w[i : n - k + 1 + i] * _ODD[i % 5] + np.uint64(i // 5)
    h = np.sort(_mixed(h).view(np.int64))
    return h[np.r_[True, h[1:] != h[:-1]]]
