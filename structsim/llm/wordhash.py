"""64-bit hashes of byte ranges, for many ranges of a column of texts at once.

A range's hash is a polynomial of its bytes modulo 2**64, had from prefix sums over the whole slice, then mixed with
the range's length. Two different words share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * _C1
    h ^= h >> np.uint64(27)
    h *= _C2
    return h ^ (h >> np.uint64(31))


def chain(*parts: np.ndarray) -> np.ndarray:
    """One hash of a tuple of hashes, in order."""
    out = mix(parts[0] + _STEP)
    for p in parts[1:]:
        out = mix(out * _STEP + p)
    return out


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(max(n, SLICE_BYTES), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[starts[k]:ends[k]]."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h ^ mix((ends - starts).astype(np.uint64)))


def give_back() -> None:
    """Returns freed memory to the system; workers stay alive between stages and would hold it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def text_slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) of a text column; a slice has ``most`` bytes or one row."""
    texts = batch.column(column)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, values = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    give_back()


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each row, A-Z lower-cased first; (hashes, word starts, words before each row).

    The last array has one more entry than there are rows: row k's words are [before[k], before[k + 1]).
    """
    if lower:
        upper = (data >= 65) & (data <= 90)
        data = data + (upper.astype(np.uint8) << np.uint8(5))
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges + 1]
    stops[edges - 1] = inside[edges]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return range_hashes(data, starts, ends), starts, np.searchsorted(starts, offsets)


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[0]:+lengths[0]], flat[starts[1]:+lengths[1]], ... as one array."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]
