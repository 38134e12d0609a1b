"""Words of many texts as 64 bit hashes, in array operations on their UTF-8 bytes.

A word is a run without space, tab, line feed, vertical tab, form feed and carriage return, none of which is a byte of another
character in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The first 0 to 8 of eight bytes.
FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
#: Bytes that a worker takes at once (one text at least).
PIECE = 3_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """The number that mix() makes x of."""

    def unshift(x: np.ndarray, by: int) -> np.ndarray:
        return x ^ (x >> np.uint64(by)) ^ (x >> np.uint64(2 * by))

    x = unshift(x, 31) * np.uint64(pow(int(M2), -1, 1 << 64))
    return unshift(unshift(x, 27) * np.uint64(pow(int(M1), -1, 1 << 64)), 30)


class Words:
    """Of texts that end in a line feed each: hash, the hashes of all words in order; at, the bytes where they begin; ends, the last
    byte of each text. lower: A-Z become a-z first. Takes some 40 bytes a word while it runs."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, lower: bool = False):
        self.bytes, self.ends = np.full(len(data) + 8, 32, dtype=np.uint8), ends  # room for the last load of eight bytes
        self.bytes[: len(data)] = LOWER[data] if lower else data
        space = SPACE[self.bytes]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self.at = edge[0::2]
        self.hash = self._hash(edge[1::2] - self.at)

    def _hash(self, size: np.ndarray) -> np.ndarray:
        eight = np.lib.stride_tricks.as_strided(self.bytes[:8].view("<u8"), shape=(len(self.bytes) - 7,), strides=(1,))
        h = size.astype(np.uint64) * M2 + (eight[self.at] & FIRST[np.minimum(size, 8)])
        more, j = np.flatnonzero(size > 8), 8
        while len(more):  # words of over j bytes
            rest = size[more] - j
            h[more] = mix(h[more]) * M2 + (eight[self.at[more] + j] & FIRST[np.minimum(rest, 8)])
            more, j = more[rest > 8], j + 8
        return mix(h)

    def counts(self, ends: np.ndarray | None = None) -> np.ndarray:
        """How many words lie before each of the bytes (the ends of the texts where none are given), from the one before it on."""
        return np.diff(np.searchsorted(self.at, self.ends if ends is None else ends), prepend=0)


def pieces(batches: Iterator[pa.RecordBatch], column: int, lower: bool = False) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """The rows of the batches, some PIECE bytes at a time, with the words of a column of non-null UTF-8 binaries that end in a line feed."""
    for b in batches:
        col = b.column(column)
        if not len(col):
            continue
        _, offsets, data = col.buffers()
        ends = np.frombuffer(offsets, dtype=np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data, row = np.frombuffer(data, dtype=np.uint8), 0
        while row < len(col):
            to = max(row + 1, int(np.searchsorted(ends, ends[row] + PIECE, "right")) - 1)
            yield b.slice(row, to - row), Words(data[ends[row] : ends[to]], ends[row + 1 : to + 1] - 1 - ends[row], lower)
            row = to
