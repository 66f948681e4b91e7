"""Words of many texts as 64-bit hashes, a block of bytes at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)  # the same table in every process
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 20


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    value = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    value[ord("A") : ord("Z") + 1] = value[ord("a") : ord("z") + 1]  # lower-case A-Z
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return value, blank, inverse


VALUE, BLANK, _INVERSE = _tables()
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _POWERS[k] = np.multiply.accumulate(row)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    buffers, n = column.buffers(), len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: ASCII characters other than letters and digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_hashes(column: pa.Array, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, place of each text's first word): words are runs
    of bytes other than ``blank`` (ASCII white space), A-Z lower-cased. Blocks end between words,
    so memory beyond the hashes is bounded whatever the texts' lengths."""
    data, offsets = string_buffers(column)
    hashes, starts, at, n = [], [], 0, len(data)
    while at < n:
        end = min(n, at + _BLOCK)
        while end < n and not blank[data[end]]:  # to the end of the word
            step = np.flatnonzero(blank[data[end : end + 65536]])
            end = end + int(step[0]) if len(step) else min(n, end + 65536)
        block = data[at:end]
        word = ~blank[block]
        edge = np.zeros(len(block) + 1, bool)  # a text begins here
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, "right")]
        edge[inside - at] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:-1]
        first, last = np.flatnonzero(first), np.flatnonzero(last)
        up, down = _powers(len(block))
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(VALUE[block] * up[: len(block)], out=sums[1:])
        hashes.append(mix((sums[last + 1] - sums[first]) * down[first]))
        starts.append(first + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


_SHINGLE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of the runs of ``width`` words of one text; a shorter text is one run."""
    n = len(hashes)
    if not n:
        return hashes
    factors = np.resize(_SHINGLE, width) * np.arange(1, 2 * width, 2, dtype=np.uint64)
    if n < width:
        return mix(np.array([(hashes * factors[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    total = hashes[: n - width + 1] * factors[0]
    for k in range(1, width):
        total += hashes[k : n - width + 1 + k] * factors[k]
    return mix(total)
