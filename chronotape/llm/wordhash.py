"""Word hashes of many texts at once, as numpy arrays: words are runs of bytes outside [\\x20\\x09-\\x0D]."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed in one go.
SLICE_BYTES = 4 << 20

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i below n at least."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        known = _POWERS[base] = (both[0], both[1])
    return known


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


class Words:
    """Words of a slice of texts: byte bounds and hash of each word, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~_SPACE[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        edges = offsets[1:-1]
        edges = edges[edges < len(data)]
        opens[edges] = inside[edges]
        self.starts = np.flatnonzero(opens)
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        before = edges[edges > 0] - 1
        closes[before] = inside[before]
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        sums = _prefix(data.astype(np.uint64) + np.uint64(1), _BYTE_BASE)
        inverse = _powers(_BYTE_BASE, len(data) + 1)[1]
        raw = (sums[self.ends] - sums[self.starts]) * inverse[self.starts]
        self.hashes = mixed(raw + (self.ends - self.starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    def windows(self, size: int, which: int = 0) -> np.ndarray:
        """Hash of the `size` words from every place, also where they run into the next text."""
        base = _WORD_BASES[which]
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        sums = _prefix(self.hashes, base)
        return mixed((sums[size:] - sums[:-size]) * _powers(base, len(self.hashes) + 1)[1][:n] + np.uint64(size))


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, Words]]:
    """(first row, number of rows, their words) for slices of a text column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        end = min(len(column), max(end, row + 1))
        part = offsets[row : end + 1] - offsets[row]
        yield row, end - row, Words(data[offsets[row] : offsets[end]], part)
        row = end


def text_shingles(words: Words, row: int, size: int, windows: np.ndarray) -> np.ndarray:
    """The distinct shingles of one text, sorted; a text of fewer words is one shingle, one without words has none."""
    first, last = words.first[row], words.first[row + 1]
    count = last - first
    if count >= size:
        return np.unique(windows[first : last - size + 1])
    if count == 0:
        return np.zeros(0, np.uint64)
    h = np.uint64(count)
    for x in words.hashes[first:last]:
        h = mixed(np.array([h ^ x], np.uint64))[0]
    return np.array([h], np.uint64)
