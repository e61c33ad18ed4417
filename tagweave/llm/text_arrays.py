"""Words of many texts as NumPy arrays: code points, word bounds and 64-bit word hashes, without a Python step per word.

A word is a maximal run of characters other than space and U+0009..U+000D.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Powers that a worker keeps for the next texts.
HELD = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, HELD), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if len(have) == HELD:  # those of a longer text are not kept
            _powers[name] = have
    return have[:n]


class Words(NamedTuple):
    points: np.ndarray  # code points of all texts, each text followed by \n
    first: np.ndarray  # where each text begins in points
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  # index of each word's text
    cum: np.ndarray  # prefix sums for hashes of parts


def words(texts: list[str]) -> Words:
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.cumsum(sizes) - sizes
    gap = (points == 32) | ((points >= 9) & (points <= 13))
    edges = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1)))
    start, end = edges[0::2], edges[1::2]
    return Words(points, first, start, end, np.searchsorted(first, start, side="right") - 1, sums(points))


def sums(points: np.ndarray) -> np.ndarray:
    c = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    c ^= c >> np.uint64(32)
    c *= _power("up", _BASE, len(c))
    out = np.empty(len(c) + 1, np.uint64)
    out[0] = 0
    np.cumsum(c, out=out[1:])
    return out


def part_hash(w: Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the characters from start to end; equal strings get equal hashes wherever they stand."""
    inverse = _power("down", _INVERSE, len(w.points) + 1)
    return mix((w.cum[end] - w.cum[start]) * inverse[start])


def window_hash(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of n successive values."""
    k = len(h) - n + 1
    if k <= 0:
        return np.empty(0, np.uint64)
    out = np.full(k, np.uint64((seed + 1) * 0xA0761D6478BD642F % 2**64), np.uint64)
    for i in range(n):
        out += h[i : i + k] * np.uint64((0xE7037ED1A0B428DB + 2 * i * 0x8EBC6AF09C88C6E3) & (2**64 - 1) | 1)
    return mix(out)


def join_hash(h: np.ndarray, seed: int = 0) -> int:
    """Hash of a whole sequence of values, in order."""
    i = np.arange(1, len(h) + 1, dtype=np.uint64)
    return int(mix(np.array([mix(h + i * _BASE).sum(dtype=np.uint64) + np.uint64(len(h) * 31 + seed)], np.uint64))[0])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
