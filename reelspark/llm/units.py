"""Words and bytes of Arrow text columns as numpy arrays, and rolling hashes over them.

Everything here works on one slice of an Arrow batch at a time, inside a Spark task, and needs
memory in proportion to the slice. A slice holds whole texts only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

# Bytes that separate words: space, tab, newline, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# Bytes that separate words once punctuation is ignored: all of ASCII but letters and digits.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(i).isalnum() for i in range(128)]
# A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply) of an array of hashes."""
    with np.errstate(over="ignore"):
        x = x.astype(U) + U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


BYTE_VALUES = mix(np.arange(256, dtype=U), 7)


@lru_cache(maxsize=8)
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    base = _MULTIPLIERS[which]
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(size, b, U)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Rolling:
    """Polynomial hashes modulo 2**64 of any stretch of a unit array."""

    def __init__(self, values: np.ndarray, which: int):
        n = len(values)
        size = 1 << max(12, int(n).bit_length())
        self.forth, self.back = _powers(which, size)
        self.sums = np.zeros(n + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(values.astype(U, copy=False) * self.forth[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[stop] - self.sums[start]) * self.back[start])


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with about `most` bytes of text: the rows, their bytes, and the row offsets. Null reads as empty."""
    column = batch.column(batch.schema.get_field_index(text))
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        stop = min(stop, n)
        yield batch.slice(at, stop - at), data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        at = stop


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop of every word, and for every text the position of its first word (one more entry at the end)."""
    inside = ~separators[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[heads] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[heads[heads > 0] - 1] = False
    stops = np.flatnonzero(inside & ~after) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of every word's bytes."""
    return Rolling(BYTE_VALUES[data], 0).of(starts, stops)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int, which: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive words within a text, and the position of its first word."""
    n = len(hashes)
    first = np.arange(max(0, n - k + 1))
    if not len(first):
        return np.zeros(0, U), first
    ends = np.repeat(bounds[1:], np.diff(bounds))
    first = first[first + k <= ends[: len(first)]]
    return Rolling(hashes, which).of(first, first + k), first


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
