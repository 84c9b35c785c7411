"""Texts of an Arrow column as numpy arrays: words, word hashes and shingles of many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text handled at once; a longer document is a chunk of its own.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_PLACE = mix(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)


class _Powers:
    """1, STEP, STEP**2, ... as far as asked for."""

    def __init__(self):
        self.table = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.table):
            self.table = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n, 256), _STEP, np.uint64))), dtype=np.uint64)
        return self.table


_POWERS = _Powers()


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first document, bytes, offsets) of runs of documents; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): bytes of each maximal run without white space, and each document's first word (and the end)."""
    text = ~_SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:] = ~text[:-1]
    after[:-1] = ~text[1:]
    inner = offsets[1:-1]
    before[inner[inner < len(data)]] = True
    after[inner[inner > 0] - 1] = True
    starts, ends = np.flatnonzero(text & before), np.flatnonzero(text & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (A-Z as a-z); spans don't overlap and are in order."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    index = place + np.repeat(starts, lengths)
    low = _LOWER[data[index]] if lower else data[index]
    value = _BYTE[low] * _POWERS.upto(int(lengths.max()))[place]
    return mix(np.add.reduceat(value, at) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): each document's k-word shingles, repeats included; of fewer words one for the whole."""
    n = len(hashes)
    counts = np.diff(first)
    value = np.zeros(n, np.uint64)
    if n >= k:
        value[: n - k + 1] = sum((hashes[j : n - k + 1 + j] * _PLACE[j] for j in range(k)), np.zeros(n - k + 1, np.uint64))
    valid = np.ones(n, bool)
    for j in range(1, k):
        valid[(first[1:] - j)[counts >= j]] = False
    for words_ in range(1, k):
        at = first[:-1][counts == words_]
        if len(at):
            value[at] = sum((hashes[at + j] * _PLACE[j] for j in range(words_)), np.full(len(at), mix(np.array([words_ + 77], np.uint64))[0], np.uint64))
            valid[at] = True
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    return mix(value[valid]), np.concatenate(([0], np.cumsum(sizes)))


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    if len(values) < 2:
        return values
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """The set of each document, sorted."""
    for _, data, offsets in chunks(column):
        starts, ends, first = words(data, offsets)
        values, at = shingles(span_hashes(data, starts, ends), first, k)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield distinct(values[a:b])
