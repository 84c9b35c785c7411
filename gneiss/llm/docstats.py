"""Statistics of documents as numbers: sizes, shares of kinds of characters, repetition. No language, no vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textnum import _PLACE, chunks, mix, span_hashes, words

#: Kinds of bytes, by example; all other ASCII and bytes from 0x80 are kinds of their own.
_KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".,;:'\"?", "shout": b"!", "bar": b"|", "symbol": b"#$%&*@^~+=<>_", "bracket": b"()[]{}/\\-", "blank": b" \t\r\x0b\x0c", "line": b"\n"}
_KIND = np.full(256, len(_KINDS), np.uint8)
for _k, _bytes in enumerate(_KINDS.values()):
    _KIND[list(_bytes)] = _k
_KIND[128:] = len(_KINDS) + 1
NAMES = (
    "log_bytes", "log_words", "word_length", "word_spread", *[f"share_{k}" for k in _KINDS], "share_other", "share_high", "log_lines", "log_words_a_line",
    "distinct_words", "top_word", "distinct_triples", "top_triple", "words_end_in_symbol", "words_all_upper", "words_a_stop", "short_words", "distinct_lines",
)


def _distinct_and_top(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each run: the share of distinct values, and the share of the most frequent."""
    n = len(at) - 1
    sizes = np.diff(at)
    distinct, top = np.ones(n), np.zeros(n)
    if len(values):
        doc = np.repeat(np.arange(n), sizes)
        order = np.lexsort((values, doc))
        v, d = values[order], doc[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
        start = np.flatnonzero(new)
        runs = np.diff([*start.tolist(), len(v)])
        most = np.zeros(n, np.int64)
        np.maximum.at(most, d[start], runs)
        distinct = np.where(sizes > 0, np.bincount(d[start], minlength=n) / np.maximum(sizes, 1), 1.0)  # as if alone in its batch
        top = most / np.maximum(sizes, 1)
    return distinct, top


def _sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[at[1:]] - total[at[:-1]]


def of_chunk(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    kind = _KIND[data]
    starts, ends, first = words(data, offsets)
    n_bytes, n_words = np.diff(offsets), np.diff(first)
    lengths = ends - starts
    hashes = span_hashes(data, starts, ends)
    shares = [_sum(kind == k, offsets) / np.maximum(n_bytes, 1) for k in range(len(_KINDS) + 2)]
    n_lines = _sum(data == 10, offsets) + 1
    per = np.maximum(n_words, 1)
    mean = _sum(lengths, first) / per
    spread = np.sqrt(np.maximum(_sum(lengths.astype(np.float64) ** 2, first) / per - mean**2, 0))
    triple = mix(hashes[:-2] * _PLACE[0] + hashes[1:-1] * _PLACE[1] + hashes[2:] * _PLACE[2]) if len(hashes) > 2 else hashes[:0]
    # triples that start in a document; the last two of each reach into the next and are left out
    inside = np.ones(len(hashes), bool)
    for j in (1, 2):
        inside[(first[1:] - j)[n_words >= j]] = False
    triple = triple[inside[: len(triple)]]
    t_at = np.concatenate(([0], np.cumsum(np.maximum(n_words - 2, 0))))
    line_ends = np.flatnonzero(data == 10)
    cut = np.union1d(line_ends + 1, offsets[:-1])
    cut = cut[cut < len(data)]
    line_at = np.searchsorted(cut, offsets)
    line_hash = span_hashes(data, cut, np.concatenate((cut[1:], [len(data)]))) if len(cut) else np.zeros(0, np.uint64)
    last = kind[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    upper = np.concatenate(([0], np.cumsum(kind == 1)))
    shouted = (upper[ends] - upper[starts] == 0) & (kind[starts] == 0) & (lengths > 1) if len(starts) else np.zeros(0, bool)
    d_words, t_words = _distinct_and_top(hashes, first)
    d_triples, t_triples = _distinct_and_top(triple, t_at)
    d_lines, _ = _distinct_and_top(line_hash, line_at)
    symbol = [list(_KINDS).index(k) for k in ("shout", "bar", "symbol")]
    return np.stack(
        [
            np.log1p(n_bytes), np.log1p(n_words), mean, spread, *shares, np.log(n_lines), np.log1p(n_words / n_lines),
            d_words, t_words, d_triples, t_triples, _sum(np.isin(last, symbol), first) / per, _sum(shouted, first) / per,
            np.log1p(n_words / (1 + shares[3] * n_bytes)), _sum(lengths <= 3, first) / per, d_lines,
        ], 1,
    ).astype(np.float32)


def of_column(column: pa.Array) -> Iterator[np.ndarray]:
    """Blocks of rows of statistics, in order; null counts as empty."""
    for _, data, offsets in chunks(column):
        yield of_chunk(data, offsets)
