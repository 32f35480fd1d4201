"""Words of whole batches as 64-bit hashes, computed from their UTF-8 bytes with numpy.

Used inside ``mapInArrow`` tasks; a batch is as large as Spark's Arrow limits allow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MULT = np.uint64(0x9E3779B97F4A7C15)
WHITE = bytes([9, 10, 11, 12, 13, 32])


def word_table(punctuation: bool) -> np.ndarray:
    """Byte -> lower-cased byte, 0 for a separator. With ``punctuation``, ASCII signs separate too."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(WHITE)] = 0
    table[0] = 0 if punctuation else 255
    if punctuation:
        for c in range(1, 128):
            if not chr(c).isalnum():
                table[c] = 0
    return table


PLAIN, ALNUM = word_table(False), word_table(True)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins and ends (n + 1 offsets); a null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """hashes: of every word in order; bounds: n + 1 offsets of the texts' words; starts, lengths: in bytes."""

    def __init__(self, column: pa.Array, table: np.ndarray = PLAIN, prefixes: tuple[int, ...] = ()):
        data, offsets = text_bytes(column)
        b = table[data]
        inside = b != 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[at] = inside[at]
        self.data, self.starts = b, np.flatnonzero(begins)
        self.bounds = np.searchsorted(self.starts, offsets)
        if not len(self.starts):
            self.hashes, self.prefixes, self.lengths = np.zeros(0, np.uint64), [np.zeros(0, np.uint64) for _ in prefixes], np.zeros(0, np.int64)
            return
        place = np.arange(len(b), dtype=np.int64) - self.starts[np.maximum(np.cumsum(begins) - 1, 0)]
        powers = np.cumprod(np.full(max(int(place.max()) + 1, 1), MULT, np.uint64))
        value = b.astype(np.uint64) * powers[np.maximum(place, 0)]
        value[: self.starts[0]] = 0
        self.lengths = np.add.reduceat(inside, self.starts, dtype=np.int64)
        self.hashes = mix(np.add.reduceat(value, self.starts))
        self.prefixes = [mix(np.add.reduceat(np.where(place < p, value, np.uint64(0)), self.starts) ^ np.uint64(p)) for p in prefixes]

    def texts(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
