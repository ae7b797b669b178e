"""Word hashes of whole Arrow string columns, without a Python object per word.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z count as a-z. Its 64-bit hash is a
polynomial in its bytes, taken as a difference of prefix sums, so one pass serves a batch of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SEED = np.random.default_rng(20240607)
_OF_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OF_BYTE[65:91] = _OF_BYTE[97:123]
_INK = np.ones(256, dtype=bool)
_INK[[9, 10, 11, 12, 13, 32]] = False
_OF_PLACE = _SEED.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CHUNK_BYTES = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as the longest chunk so far needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, CHUNK_BYTES + 1)
            inverse = np.uint64(pow(int(_BASE), -1, 2**64))
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b)])) for b in (_BASE, inverse))
        return self.up, self.down


_POWERS = _Powers()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; a null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer row is a run of its own."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, the places of its first byte and after its last, and per row the offset of its first word."""
    n = len(data)
    if n == 0:
        nothing = np.zeros(0, dtype=np.int64)
        return nothing.astype(np.uint64), nothing, nothing, np.zeros(len(offsets), dtype=np.int64)
    ink = np.zeros(n + 2, dtype=bool)
    ink[1:-1] = _INK[data]
    first = ink[1:-1] & ~ink[:-2]
    last = ink[1:-1] & ~ink[2:]
    cuts = offsets[(offsets > 0) & (offsets < n)]  # a row's end also ends its last word
    first[cuts] |= ink[1:-1][cuts]
    last[cuts - 1] |= ink[1:-1][cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _POWERS.upto(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_OF_BYTE[data] * up[:n], out=total[1:])
    h = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return h, start, end, np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, row_first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words and per row the offset of its first; a row of fewer words (but
    one at least) has one shingle of all of them."""
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(row_first), dtype=np.int64)
    padded = np.concatenate([words, np.zeros(width - 1, dtype=np.uint64)])
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        h += padded[k : k + n] * _OF_PLACE[k]
    counts = np.diff(row_first)
    keep = np.ones(n, dtype=bool)
    for row in np.flatnonzero((counts > 0) & (counts < width)):
        a, b = row_first[row], row_first[row + 1]
        h[a] = np.uint64(len(words[a:b])) + sum((words[a + k] * _OF_PLACE[k] for k in range(b - a)), np.uint64(0))
        keep[a + 1 : b] = False
    long = counts >= width
    for k in range(1, width):
        keep[row_first[1:][long] - k] = False
    return mixed(h)[keep], np.concatenate([[0], np.cumsum(keep)])[row_first]
