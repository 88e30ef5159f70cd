"""Directly addressable codes: token ids in byte levels with continuation bitmaps.

An id is cut into bytes, lowest first. Level 0 holds the first byte of every id, level
1 the second byte of those ids that have one, and so on. A bitmap per level marks the
ids that continue; counting its ones before a position (``rank``) gives the place in
the next level. A directory holds that count for every 512th position, so any id is
found with one short count a level and nothing before it is decoded.

Layout, little-endian: magic, number of ids (u64), number of levels (u64), then for
each level its length (u64), and for each level its bytes, bitmap and directory (u32).
"""

from __future__ import annotations

import numpy as np

MAGIC = b"DACv1\0\0\0"
#: Positions between two entries of the directory.
STEP = 512


def _tail_sizes(length: int) -> tuple[int, int]:
    """Bytes of the bitmap and of the directory of a level."""
    return (length + 7) // 8, 4 * (length // STEP + 1)


def pack(ids: np.ndarray) -> bytes:
    """Encode unsigned ids; an empty array is allowed."""
    rest = np.asarray(ids, dtype=np.uint64)
    lengths, parts = [], []
    while True:
        more = rest > 0xFF
        lengths.append(len(rest))
        marks = np.packbits(more, bitorder="little")
        before = np.concatenate(([0], np.cumsum(more, dtype=np.int64)))
        parts += [
            (rest & 0xFF).astype(np.uint8).tobytes(),
            marks.tobytes(),
            before[: len(rest) + 1 : STEP].astype("<u4").tobytes(),
        ]
        if not more.any():
            break
        rest = rest[more] >> np.uint64(8)
    head = np.array([lengths[0], len(lengths), *lengths], "<u8").tobytes()
    return b"".join([MAGIC, head, *parts])


class Codes:
    """Read access to packed ids."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        self.data = memoryview(data)
        count, levels = np.frombuffer(data, "<u8", 2, len(MAGIC))
        self.count = int(count)
        at = len(MAGIC) + 16
        lengths = [int(x) for x in np.frombuffer(data, "<u8", int(levels), at)]
        at += 8 * len(lengths)
        self.levels = []
        for length in lengths:
            bitmap, directory = _tail_sizes(length)
            chunk_at, bitmap_at, directory_at = at, at + length, at + length + bitmap
            at = directory_at + directory
            self.levels.append(
                (
                    np.frombuffer(data, np.uint8, length, chunk_at),
                    self.data[bitmap_at:directory_at],
                    np.frombuffer(data, "<u4", directory // 4, directory_at),
                )
            )

    def __len__(self) -> int:
        return self.count

    @staticmethod
    def _rank(bitmap: memoryview, directory: np.ndarray, position: int) -> int:
        """Ones before a position."""
        block = position // STEP
        bits = int.from_bytes(bitmap[block * (STEP // 8) : (position + 7) // 8], "little")
        inside = position - block * STEP
        return int(directory[block]) + (bits & ((1 << inside) - 1)).bit_count()

    def __getitem__(self, position: int) -> int:
        if not 0 <= position < self.count:
            raise IndexError(position)
        value = 0
        for depth, (chunks, bitmap, directory) in enumerate(self.levels):
            value |= int(chunks[position]) << (8 * depth)
            if not bitmap[position >> 3] >> (position & 7) & 1:
                break
            position = self._rank(bitmap, directory, position)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids of a range; reads only that range of each level."""
        if not 0 <= start <= stop <= self.count:
            raise IndexError((start, stop))
        values = np.zeros(stop - start, np.uint32)
        where = np.arange(stop - start)
        for depth, (chunks, bitmap, directory) in enumerate(self.levels):
            values[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(8 * depth)
            first = start >> 3
            bits = np.unpackbits(
                np.frombuffer(bitmap[first : (stop + 7) >> 3], np.uint8), bitorder="little"
            )[start - 8 * first : stop - 8 * first].astype(bool)
            where = where[bits]
            if not len(where):
                break
            start = self._rank(bitmap, directory, start)
            stop = start + len(where)
        return values
