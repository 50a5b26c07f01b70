"""Vectorised text features over Arrow string columns: word hashes, character
n-gram hashes and byte classes of many documents at once, in pieces of bounded
size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # of text handled at once; a longer document is one chunk

_RNG = np.random.default_rng(20240601)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32  # A-Z
_FOLDED = _BYTE[FOLD]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK_BYTES + 1, n)
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, _BASE), np.full(size, _BASE_INV)
        up[0] = down[0] = 1
        _POWERS[size] = np.cumprod(up), np.cumprod(down)
    return _POWERS[size]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class RollingHash:
    """Hashes of any slices of a byte array in constant time each."""

    def __init__(self, data: np.ndarray, folded: bool = True):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_FOLDED if folded else _BYTE)[data] * up[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows with at most CHUNK_BYTES
    together, or of a single longer row."""
    body, at = texts(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, side="right")) - 1)
        yield i, body[at[i]:at[j]], at[i:j + 1] - at[i]
        i = j


def spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of each maximal run of word bytes; runs end with
    their document."""
    if not len(is_word):
        return (np.zeros(0, np.int64),) * 3
    before = np.empty_like(is_word)
    before[0], before[1:] = False, is_word[:-1]
    after = np.empty_like(is_word)
    after[-1], after[:-1] = False, is_word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(is_word))]
    before[inner] = False
    after[inner - 1] = False
    start, end = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    return np.searchsorted(offsets, start, side="right") - 1, start, end


def byte_table(chars) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


BLANK = byte_table([32, *range(9, 14)])
# letters, digits and all bytes of non-ASCII characters
ALNUM = byte_table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
