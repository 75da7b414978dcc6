"""Vectorised sequence kernels shared by the text operators of this subpackage.

A batch of texts is laid out as one array of code points, so that every step
(hashing, sliding minima, run detection) is a fixed number of numpy passes over
the batch and never a Python loop over characters.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 2**64)
_POSITION_BITS = np.uint64(24)
_POSITION_MASK = np.uint64((1 << 24) - 1)
NOWHERE = np.uint64(2**64 - 1)
MAX_CHUNK = 1 << 23


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words, in a new array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= _ODD
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n + 1, _BASE, dtype=np.uint64)
    down = np.full(n + 1, _INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, up to at least ``n``."""
    size = 1 << max(12, int(n).bit_length())
    return _powers(size)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one uint32 array, and the offsets (one more than texts)."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return data, offsets


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` consecutive values (``len - k + 1`` of them)."""
    n = len(values)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    up, down = powers(n)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(values) * up[:n], out=prefix[1:])
    return mix((prefix[k:] - prefix[:-k]) * down[: n - k + 1])


def sliding_argmin(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes, the place of its leftmost minimum.

    Hash and place share one word, so equal hashes resolve to the left one, and
    the windows of two equal sequences choose the same relative place.
    """
    n = len(hashes)
    if n < width:
        return np.empty(0, dtype=np.int64)
    if n > MAX_CHUNK:
        raise ValueError("one call takes at most 2**23 values; split the sequence")
    word = (hashes & ~_POSITION_MASK) | np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        word = np.minimum(word[:-span], word[span:])
        span *= 2
    rest = width - span
    if rest:
        word = np.minimum(word[:-rest], word[rest:])
    return (word & _POSITION_MASK).astype(np.int64)


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """The distinct places chosen by any window of ``width``, ascending."""
    found = sliding_argmin(hashes, width)
    if not len(found):
        return found
    keep = np.ones(len(found), dtype=bool)
    keep[1:] = found[1:] != found[:-1]
    return np.unique(found[keep])


def pieces(n: int, width: int, most: int = MAX_CHUNK):
    """Bounds of overlapping pieces such that each window of ``width`` lies whole in one."""
    start = 0
    while True:
        stop = min(n, start + most)
        yield start, stop
        if stop >= n:
            return
        start = stop - width + 1


def cartesian_bounds(hashes: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Compact windows of the surviving nodes of a Cartesian tree.

    ``places`` holds the nodes whose subtree is at least as wide as the wanted
    length, with their ``hashes``; an ancestor of such a node is such a node, so
    the bounds found among them are those of the whole tree. Node ``c`` is the
    leftmost minimum of exactly the subsequences [i, j] with l <= i <= c <= j <= r.
    """
    m = len(places)
    left = np.zeros(m, dtype=np.int64)
    right = np.full(m, n - 1, dtype=np.int64)
    stack: list[int] = []
    keys = ((hashes & ~_POSITION_MASK) >> _POSITION_BITS).tolist()
    at = places.tolist()
    lefts, rights = left.tolist(), right.tolist()
    for i in range(m):
        while stack and keys[stack[-1]] > keys[i]:
            rights[stack.pop()] = at[i] - 1
        if stack:
            lefts[i] = at[stack[-1]] + 1
        stack.append(i)
    return np.asarray(lefts, dtype=np.int64), np.asarray(rights, dtype=np.int64)


@lru_cache(maxsize=1)
def _word_table() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: whether it is a letter or a decimal digit, and its lower case.

    Lower case is one code point here; the one letter that lowers to two (U+0130)
    stays itself, which equals itself just as well.
    """
    size = 0x110000
    inside = np.zeros(size, dtype=bool)
    lower = np.arange(size, dtype=np.uint32)
    for c in range(size):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L" or kind == "Nd":
            inside[c] = True
            low = chr(c).lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return inside, lower


def word_arrays(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in order, and the word offsets of the texts.

    Words are maximal runs of Unicode letters and digits.
    """
    inside, lower = _word_table()
    data, offsets = code_points(texts)
    n = len(data)
    counts = np.zeros(len(texts) + 1, dtype=np.int64)
    if not n:
        return np.empty(0, dtype=np.uint64), counts
    flag = inside[data]
    first = flag.copy()
    first[1:] &= ~flag[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = flag[cuts]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), counts
    up, down = powers(n)
    scrambled = mix(lower[data]) * up[:n]
    scrambled[~flag] = 0
    sums = np.add.reduceat(scrambled, starts)
    hashes = mix(sums * down[starts])
    counts[1:] = np.searchsorted(starts, offsets[1:], side="left")
    return hashes, counts
