"""Words of many texts at once: 64-bit hashes of words and shingles, straight from the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEGMENT = 1 << 19  # bytes hashed at once
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.cumprod(np.full(4096, _BASE))
_LANES = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

#: ASCII upper case to lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LOWERED = _BYTE[LOWER]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which bytes lie in the given ranges (both ends included)."""
    mask = np.zeros(256, dtype=bool)
    for low, high in ranges:
        mask[low:high + 1] = True
    return mask


#: Words between blanks, ``[^\x20\x09-\x0D]+``.
BLANKS = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words of letters and digits, ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
SYMBOLS = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each text starts (one more entry for the end); null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def groups_by_size(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive items in groups of about ``most`` in total; a larger item is alone or ends its group."""
    ends, total, start = [], 0, 0
    for i, s in enumerate(sizes):
        total += int(s)
        if total >= most:
            ends.append((start, i + 1))
            start, total = i + 1, 0
    if start < len(sizes):
        ends.append((start, len(sizes)))
    return ends


def _segment(buf: np.ndarray, separators: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and hash of each word; no word runs over a position in ``breaks``."""
    inside = ~separators[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = breaks[breaks < len(buf)]
    first[at] = inside[at]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    last = inside
    last[:-1] &= ~inside[1:] | first[1:]
    lengths = np.flatnonzero(last) + 1 - starts
    begin = np.append(0, np.cumsum(lengths)[:-1])
    j = np.arange(begin[-1] + lengths[-1]) - np.repeat(begin, lengths)
    value = _LOWERED[buf[j + np.repeat(starts, lengths)]] * _LOW[j & 4095]
    if (longest := int(lengths.max())) > 4096:
        high = np.cumprod(np.full(longest // 4096 + 1, _LOW[-1]))
        high[1:], high[0] = high[:-1].copy(), 1
        value *= high[j >> 12]
    return starts, lengths, mix(np.add.reduceat(value, begin) + lengths.astype(np.uint64) * _BASE)


def words(buf: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts: byte position, length, hash (of the lower-cased word), and where each text's words start.

    A text is cut into segments at separators, so memory beyond the result is bounded also for very
    long texts (a word is never cut).
    """
    parts, a, n = [], 0, len(buf)
    while a < n:
        b = min(n, a + _SEGMENT)
        if b < n:
            edge = off[np.searchsorted(off, b, "right") - 1]
            if edge > a:
                b = int(edge)
            else:
                cut, width = -1, _SEGMENT
                while cut < 0 and b < n:  # the next separator or end of the text
                    found = np.flatnonzero(separators[buf[b:b + width]])
                    end = int(off[np.searchsorted(off, b, "left")])
                    if len(found):
                        cut = min(b + int(found[0]), end)
                    elif b + width >= end:
                        cut = end
                    else:
                        b += width
                b = cut if cut >= 0 else n
        lo, hi = np.searchsorted(off, a, "left"), np.searchsorted(off, b, "left")
        s, length, h = _segment(buf[a:b], separators, off[lo:hi] - a)
        parts.append((s + a, length, h))
        a = b
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    starts, lengths, hashes = (np.concatenate(x) for x in zip(*parts))
    return starts, lengths, hashes, np.searchsorted(starts, off, "left")


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k`` consecutive words from each word on, and where each text's shingles start.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    counts = np.diff(first)
    own = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.append(0, np.cumsum(own))
    src = np.repeat(first[:-1] - begin[:-1], own) + np.arange(begin[-1])
    width = np.repeat(np.minimum(counts, k), own)
    total = width.astype(np.uint64) * _BASE
    for i in range(k):
        use = width > i
        total[use] += hashes[src[use] + i] * _LANES[i]
    return mix(total), begin
