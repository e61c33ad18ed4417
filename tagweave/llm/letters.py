"""Letter runs of many texts as arrays, and the scripts of letters."""

from __future__ import annotations

from functools import cache

import numpy as np

from tagweave.llm.text_arrays import Words, sums

#: First and last code points of scripts.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "thai": ((0xE00, 0xE7F),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)),
}
OTHER = len(SCRIPTS)


@cache
def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@cache
def script_table() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for i, ranges in enumerate(SCRIPTS.values()):
        for lo, hi in ranges:
            out[lo : hi + 1] = i
    return out


def letter_runs(texts: list[str]) -> Words:
    """Runs of letters of the lower-cased texts; everything else separates them."""
    joined = "\n".join(t.lower() for t in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    plain = np.where(letter_table()[points], points, np.uint32(32))
    ends = np.cumsum(np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts))) - 1
    plain[ends] = 10
    return words_from(plain, ends)


def words_from(plain: np.ndarray, ends: np.ndarray) -> Words:
    gap = plain <= 32
    edges = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1)))
    start, end = edges[0::2], edges[1::2]
    first = np.concatenate([[0], ends[:-1] + 1])
    return Words(plain, first, start, end, np.searchsorted(first, start, side="right") - 1, sums(plain))
