"""Words, lines and word shingles of whole texts as 64-bit hashes, a batch of texts at a time.

Words are maximal runs of bytes other than space and U+0009..U+000D, with A-Z
lower-cased. A span's hash is a polynomial over its bytes, read off running
sums of the whole batch, so no Python code runs per word or line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each text's start in them (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(starts: np.ndarray, most: int):
    """Runs of texts of at most ``most`` bytes together; a longer text is a run of its own."""
    first, n = 0, len(starts) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(starts, starts[first] + most, "right")) - 1)
        yield first, end
        first = end


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word; a text's end ends its last word."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    cut = np.unique(starts[1:-1])
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
    begin = np.sort(np.concatenate([np.flatnonzero(edge == 1), cut]))
    end = np.sort(np.concatenate([np.flatnonzero(edge == -1), cut]))
    return begin, end


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A hash of the A-Z-lowered bytes of each span; it does not depend on the batch."""
    with np.errstate(over="ignore"):
        power = np.full(len(data) + 1, np.uint64(base))
        power[0] = 1
        np.cumprod(power, out=power)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[data]] * power[:-1], out=sums[1:])
        total = sums[end] - sums[begin]
        del sums
        # An odd base has an inverse modulo 2**64, which takes the span's place out of its hash.
        power.fill(np.uint64(pow(base, -1, 1 << 64)))
        power[0] = 1
        np.cumprod(power, out=power)
        return mix(total * power[begin] + (end - begin).astype(np.uint64))


def line_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stripped begin and end of every \\n-split line of every text, and each text's first line."""
    breaks = np.flatnonzero(data == 0x0A)
    n = len(starts) - 1
    # A line starts at each text's start and after each break; an empty text is one empty line.
    owner = np.searchsorted(starts, breaks, "right") - 1
    begin = np.concatenate([starts[:-1], breaks + 1])
    text = np.concatenate([np.arange(n), owner])
    order = np.lexsort((np.concatenate([np.zeros(n, np.int8), np.ones(len(breaks), np.int8)]), begin, text))
    begin, text = begin[order], text[order]
    last = np.ones(len(begin), bool)
    last[:-1] = text[1:] != text[:-1]
    end = np.where(last, starts[text + 1], np.roll(begin, -1) - 1)
    solid = np.flatnonzero(~_SPACE[data])
    low, high = np.searchsorted(solid, begin), np.searchsorted(solid, end)
    blank = low == high
    if len(solid):
        begin = np.where(blank, begin, solid[np.minimum(low, len(solid) - 1)])
        end = np.where(blank, begin, solid[np.maximum(high - 1, 0)] + 1)
    else:
        end = begin.copy()
    return begin, end, np.searchsorted(text, np.arange(n + 1))


def code_points(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points in each span of UTF-8 bytes."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=sums[1:])
    return sums[end] - sums[begin]


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and each text's first word among them."""
    begin, end = word_spans(data, starts)
    return span_hashes(data, begin, end), np.searchsorted(begin, starts)


def shingle_sets(data: np.ndarray, starts: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingle hashes in ascending order; fewer words than ``width`` make one shingle."""
    hashes, first = word_hashes(data, starts)
    counts = np.diff(first)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
        for k in range(width):
            rolled = rolled * np.uint64(_BASE) + hashes[k : k + len(rolled)]
        rolled = mix(rolled)
        out = []
        for at, n in zip(first[:-1].tolist(), counts.tolist(), strict=True):
            if n >= width:
                out.append(np.unique(rolled[at : at + n - width + 1]))
            elif n:
                short = np.uint64(n)
                for h in hashes[at : at + n]:
                    short = short * np.uint64(_BASE) + h
                out.append(mix(np.array([short], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
