"""Words, bytes and rolling hashes of whole Arrow text columns, as numpy arrays.

Texts are read in place from Arrow's buffers, several documents at a time. A rolling hash gives the
hash of any run of tokens from two prefix sums, so shingles, windows and k-mers all cost a few array
passes however long the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once, and where tasks of several kinds follow each other in one worker; one longer document
#: is worked on alone.
CHUNK, SMALL = 1 << 21, 1 << 19

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; the longest asked for is kept."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full((n | (1 << 18) - 1) + 1, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(steps)
    return have[:n]


class Rolling:
    """Hashes of runs of a code sequence."""

    def __init__(self, codes: np.ndarray):
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(codes * _power(_MULT, len(codes)), out=self.sums[1:])

    def run(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of each codes[start:stop]; runs of different lengths differ."""
        raw = (self.sums[stop] - self.sums[start]) * _power(_INVERSE, len(self.sums))[start]
        return mixed(raw + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def every(self, width: int) -> np.ndarray:
        """Hash of the run of ``width`` codes at every start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        raw = (self.sums[width:] - self.sums[:n]) * _power(_INVERSE, n)
        return mixed(raw + np.uint64(width * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets of the rows in them); null texts are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(ends, ends[row] + most, side="right")) - 1)
        yield row, end, data[ends[row]:ends[end]], ends[row:end + 1] - ends[row]
        row = end


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, other bytes as they are."""
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop byte of each word, and for each row the number of words before it.

    A word is a longest run of bytes other than blanks, tabs and line ends inside one row.
    """
    solid = ~_SPACE[data]
    inner = offsets[1:-1]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = inner[inner < len(data)]
    first[begins] = solid[begins]
    last = solid
    last[:-1] &= ~solid[1:] | first[1:]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_codes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return Rolling(_BYTE[data]).run(starts, stops)


def shingles(codes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of each row's shingles in order, and the offsets of the rows in them.

    A row of fewer than ``width`` words has its whole sequence as one shingle, an empty row none.
    """
    length = np.diff(offsets)
    count = np.where(length >= width, length - width + 1, np.minimum(length, 1))
    ends = np.concatenate(([0], np.cumsum(count)))
    start = np.repeat(offsets[:-1] - ends[:-1], count) + np.arange(ends[-1])
    stop = start + np.repeat(np.minimum(length, width), count)
    return Rolling(codes).run(start, stop) >> np.uint64(1), ends


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, type=pa.int64())


def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), longs(values))
