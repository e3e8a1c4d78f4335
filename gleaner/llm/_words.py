"""Words and their hashes over Arrow string columns, vectorised with numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D.  UTF-8 never uses these bytes inside a
longer sequence, so byte offsets are exact word edges.  Everything works on blocks of whole texts whose bytes
sum to about ``BLOCK``; a longer text has a block to itself, so memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64
_MASK = (1 << 64) - 1
_R = 0x9E3779B97F4A7C15

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII but for letters and digits.
MARKS = np.ones(256, bool)
MARKS[128:] = MARKS[48:58] = MARKS[65:91] = MARKS[97:123] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all of them."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_R))
_BYTE_FOLDED = _BYTE[_FOLD]
_POWERS = np.ones(1, U)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        out = np.full(max(n, 64), _R, U)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        _POWERS = out
    return _POWERS[:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, off, data = column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole rows of about ``limit`` bytes."""
    data, offsets = flat(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


@dataclass
class Words:
    """Words of a block: edges in its bytes, 64-bit hashes, the row of each, and where each row's words begin."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def split(data: np.ndarray, offsets: np.ndarray, fold: bool = False, between: np.ndarray = SPACE) -> Words:
    """``fold``: A-Z hash as a-z; nothing else is folded.  ``between``: the bytes that separate words."""
    n = len(offsets) - 1
    word = ~between[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] |= word[edge]  # a text's first byte begins a word though the text before ended in one
    start = np.flatnonzero(begins)
    stops = np.zeros(len(data) + 1, bool)
    stops[1:] = word
    stops[1:-1] &= ~word[1:] | begins[1:]
    end = np.flatnonzero(stops)
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(n), np.diff(first))
    if not len(start):
        return Words(start, end, np.zeros(0, U), row, first)
    length = end - start
    at = np.flatnonzero(word)
    inside = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    value = (_BYTE_FOLDED if fold else _BYTE)[data[at]] * _powers(int(length.max()))[inside]
    return Words(start, end, mix(np.add.reduceat(value, np.cumsum(length) - length)), row, first)


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of n words that lies in one row."""
    total = len(words.hash)
    if total < n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    h = np.zeros(total - n + 1, U)
    for i in range(n):
        h = h * U(_R) + words.hash[i : total - n + 1 + i]
    at = np.flatnonzero(words.row[: total - n + 1] == words.row[n - 1 :])
    return at, mix(h[at])


def varint(values: np.ndarray) -> bytes:
    """Unsigned integers as planes of bytes, the lowest first, each as long as it has to be; see ``unvarint``."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = 1 if not len(values) else max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(planes.T).tobytes()


def unvarint(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()
