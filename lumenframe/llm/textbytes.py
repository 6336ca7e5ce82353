"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a maximal run of digits, letters a-z (A-Z are lower-cased) and all bytes from 0x80 on, which is the
character class ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` over code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20  # of text worked on at once, but for single longer documents

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
PRIME = np.uint64(0x9E3779B97F4A7C15)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of rows with about ``limit`` bytes of text and their texts' bytes; only one range's texts are held at once."""
    column = column.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ends = np.cumsum(sizes)
    first = 0
    while first < len(ends):
        start = int(ends[first] - sizes[first])
        last = max(first + 1, int(np.searchsorted(ends, start + limit, side="right")))
        yield first, last, [b"" if x is None else x for x in column.slice(first, last - first).to_pylist()]
        first = last


def mixed(h: np.ndarray) -> np.ndarray:
    """A finishing mix of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, PRIME, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """hashes (uint64) of all words, in order; first: index of each text's first word, with the end appended."""

    def __init__(self, texts: list[bytes]):
        joined = np.frombuffer(b"\x00" + b"\x00".join(texts) + b"\x00", np.uint8)
        self.buffer = LOWER[joined]
        mask = IS_WORD[self.buffer]
        edges = np.flatnonzero(mask[1:] != mask[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        bounds = np.cumsum([0] + [len(x) + 1 for x in texts])
        self.first = np.searchsorted(self.starts, bounds + 1)
        n = len(self.starts)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        if not n:
            self.hashes = np.zeros(0, np.uint64)
            return
        chars = np.flatnonzero(mask)
        lengths = self.ends - self.starts
        offsets = np.cumsum(lengths) - lengths
        within = np.arange(len(chars)) - np.repeat(offsets, lengths)
        values = (self.buffer[chars].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[within]
        self.hashes = mixed(np.add.reduceat(values, offsets) + lengths.astype(np.uint64))
