"""Words of many texts at once, as numpy arrays over an Arrow string column's bytes.

Texts are UTF-8; a word is a run of bytes other than 0x20 and 0x09-0x0D, so that no
character is ever cut. A word or a row of words stands for itself as a 64-bit hash: among
n different ones, two share a hash with probability n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Odd multipliers of the mixing steps (from the 64-bit golden ratio and a public finaliser).
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Bytes of text that are worked on at once; a longer text makes a window of its own.
WINDOW = 2 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * M3
    return h ^ (h >> np.uint64(31))


@dataclass
class Window:
    """Rows ``first`` to ``first + n`` of a batch: their bytes (lower case, 8 bytes of padding) and where each begins."""

    first: int
    n: int
    data: np.ndarray
    offsets: np.ndarray  # n + 1, into data
    valid: np.ndarray

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, length and row (0 to n - 1) of each word, in order."""
        return self.runs(~SPACE[self.data[: self.offsets[-1]]])

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of ``inside`` within rows."""
        if not len(inside):
            return (np.zeros(0, np.int64),) * 3
        cut = np.zeros(len(inside) + 1, bool)
        cut[self.offsets] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | cut[1:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | cut[1:-1]
        at = np.flatnonzero(begin)
        return at, np.flatnonzero(end) + 1 - at, np.searchsorted(self.offsets, at, "right") - 1


def windows(column: pa.Array, limit: int = WINDOW, lower: bool = True) -> Iterator[Window]:
    """The rows of a string column, null as empty, in windows of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = np.ones(len(column), bool) if not column.null_count else np.asarray(column.is_valid())
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        part = np.zeros(int(offsets[last] - offsets[first]) + 8, np.uint8)
        part[:-8] = data[offsets[first] : offsets[last]]
        yield Window(first, last - first, LOWER[part] if lower else part, offsets[first : last + 1] - offsets[first], valid[first:last])
        first = last


def hash_spans(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, eight bytes a step; ``data`` has 8 bytes of padding."""
    wide = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = length.astype(np.uint64) * M1
    live, pos, left = np.arange(len(at)), at, length
    while len(live):
        chunk = wide[pos]
        short = left < 8
        chunk[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[live] = mix((h[live] + M1) ^ (chunk * M2))
        on = left > 8
        live, pos, left = live[on], pos[on] + 8, left[on] - 8
    return h


def hash_rows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` hashes that stand side by side."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width + 1, np.uint64) * M3
    for k in range(width):
        out = mix((out + M1) ^ (h[k : k + n] * M2))
    return out


def row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, values, n) if len(values) else np.zeros(n)
