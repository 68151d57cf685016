"""Word shingles as sorted sets of 64-bit hashes, computed on bytes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words per shingle.
WORDS = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_M1, _M2, _S1, _S2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(31), np.uint64(29)


class _Words(dict):
    """A word's hash; kept for the words seen last, up to a number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_words = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> _S1
    h *= _M1
    h ^= h >> _S2
    h *= _M2
    h ^= h >> _S1
    return h


def shingle_list(text: bytes | None) -> np.ndarray:
    """A hash for each shingle, in order and with repeats. A-Z are lower-cased, words are runs of
    bytes other than 9-13 and 32; fewer than five words are one shingle, no word none."""
    words = (text or b"").lower().split()
    if len(_words) > 200_000:
        _words.clear()
    a = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if not len(a):
        return a
    if len(a) < WORDS:
        return _mix((a * _ODD[: len(a)]).sum(keepdims=True) + np.uint64(len(a)))
    n = len(a) - WORDS + 1
    h = a[:n] * _ODD[0]
    for i in range(1, WORDS):
        h += a[i : n + i] * _ODD[i]
    return _mix(h)


def shingle_set(text: bytes | None) -> np.ndarray:
    return np.unique(shingle_list(text))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets that aren't empty."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each low part of the hashes of a set; the least power of two of bits that is twice
    its size or more, and 64 at least."""
    size = max(64, 1 << (2 * len(s) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bits: int, size: int, to: int) -> int:
    """The bitmap of `to` bits that follows from one of size bits, both powers of two."""
    while size > to:
        size //= 2
        bits = (bits & ((1 << size) - 1)) | (bits >> size)
    return bits
