"""Best-fit packing by sum of squares.

Documents become token ids followed by id 0; only those longer than a sequence are cut. Pieces
are then packed in groups of bounded size: longest first, each piece goes to the open bin for
which the sum over residual gaps of the squared number of open bins with that gap becomes
smallest; a new bin opens only when no open one has room. A group leaves a handful of partly
filled bins at most, so larger groups waste less; memory per task stays bounded by GROUP.

Where documents have an order (training positions), groups are short ranges of it, sequences are
numbered along it, and copies of a document never share a sequence.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

CAPACITY = 2048
#: Pieces packed together.
GROUP = 100_000
#: Pieces packed together where the order of documents counts: a range that is short against training, and still wastes little.
ORDERED_GROUP = 4_000
#: Words whose ids a worker remembers; those met first stay. Longer ones are looked up each time.
MEMO, MEMO_CHARS = 400_000, 64
#: Bits of a sequence's number for its place in a group, and of a group's for its range of a file.
_BIN_BITS, _RANGE_BITS = 24, 18

#: Letters of Latin-1 (single code points, their lower case too), then marks that end words.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%&$*#|]*)")


def _byte_letters() -> dict[int, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {b: b for b in keep} | {b: 0x100 + i for i, b in enumerate(rest)}


class WordIds(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins what white space parts, so ids of words
    joined together are the ids of the text. Plain words skip normalisation and offsets.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole, self.letters = Tokenizer.from_file(path), _byte_letters()
        self.model = self.whole.model

    def __missing__(self, word: str) -> bytes:
        if m := _PLAIN.fullmatch(word):
            parts = [p.encode().decode("latin-1").translate(self.letters) for p in (m[1].lower(), m[2]) if p]
            ids = [t.id for p in parts for t in self.model.tokenize(p)]
        else:
            ids = self.whole.encode(word, add_special_tokens=False).ids
        out = array("I", ids).tobytes()
        if len(word) <= MEMO_CHARS and len(self) < MEMO:
            self[word] = out
        return out

    def of(self, text: str) -> bytes:
        # only these two part words here: other white space stays inside and is the tokenizer's to drop
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) + b"\0\0\0\0"


def stored_place(docs: DataFrame) -> Column:
    """Where a row lies in the files it is read from: number of the file, then row; ascending over a table written in order."""
    meta = docs.metadataColumn("_metadata")
    number = lambda p: F.coalesce(F.regexp_extract(meta["file_name"], p, 1).try_cast("long"), F.lit(0).cast("long"))
    return F.shiftleft(number(r"part-(\d+)"), 40) + F.shiftleft(number(r"-c(\d+)\."), 32) + meta["row_index"]


_PIECES = pa.schema([("place", pa.int64()), ("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, place: Column | None = None) -> DataFrame:
    """place, id, piece, start, length, ids_crc32 of each piece of at most ``capacity`` ids; place is that of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordIds(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for at, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = memo.of(text.as_py() or "")
                for k in range(0, len(ids) // 4, capacity):
                    part = ids[4 * k : 4 * (k + capacity)]
                    rows.append((at, key, k // capacity, k, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, _PIECES, strict=True)], schema=_PIECES)

    place = F.lit(0) if place is None else place
    docs = docs.select(place.cast("long").alias("place"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, "place long, id long, piece int, start long, length long, ids_crc32 long")


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; lengths are taken from long to short, equal ones as they come.

    ``apart`` numbers those that must not share a bin with others of their number; -1 may lie anywhere.
    """
    open_bins = np.zeros(capacity + 1, np.int64)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    held: dict[int, set[int]] = defaultdict(set)
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        room = open_bins[size:]
        # moving a bin from gap g to g - size changes the sum of squares by 2 * (N[g - size] - N[g]) + 2;
        # a bin that becomes full is not open any more: 1 - 2 * N[g]
        change = open_bins[: capacity + 1 - size] - room
        fits = np.flatnonzero(room)
        gap, b = capacity, -1
        if len(fits):
            cost = 2 * change[fits] + 2
            if fits[0] == 0:
                cost[0] = 1 - 2 * room[0]
            if apart is None or apart[k] < 0:
                gap = size + int(fits[int(cost.argmin())])
                b = by_gap[gap].pop()
            else:
                no = held[int(apart[k])]
                found = ((size + int(g), b) for g in fits[np.argsort(cost, kind="stable")] for b in reversed(by_gap[size + int(g)]) if b not in no)
                gap, b = next(found, (capacity, -1))
                if b >= 0:
                    by_gap[gap].remove(b)
        if b >= 0:
            open_bins[gap] -= 1
        else:
            b, n = n, n + 1
        if apart is not None and apart[k] >= 0:
            held[int(apart[k])].add(b)
        bins[k], offsets[k] = b, capacity - gap
        if gap > size:
            by_gap[gap - size].append(b)
            open_bins[gap - size] += 1
    return bins, offsets


def _repeated(ids: pa.ChunkedArray) -> np.ndarray:
    """A number for each id that occurs again, -1 for others and nulls."""
    null = ids.is_null().to_numpy()
    _, at, n = np.unique(ids.fill_null(0).to_numpy(), return_inverse=True, return_counts=True)
    return np.where(null | (n[at] < 2), -1, at)


def _ordered(table: pa.Table, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) with bins numbered by the first place they hold, and their pieces in order of place."""
    place, piece, length = (table.column(c).to_numpy() for c in ("place", "piece", "length"))
    order = np.lexsort((piece, place, bins))
    start = np.flatnonzero(np.concatenate(([True], bins[order][1:] != bins[order][:-1]))) if len(order) else np.zeros(0, np.int64)
    number = np.empty(len(start), np.int64)
    number[np.argsort(place[order][start], kind="stable")] = np.arange(len(start))
    each = np.repeat(np.arange(len(start)), np.diff([*start.tolist(), len(order)]))
    before = np.concatenate(([0], np.cumsum(length[order])))[:-1]
    out, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    out[order], offset[order] = number[each], before - before[start][each]
    return out, offset


def _range_of(rows: DataFrame, group: int) -> Column:
    """Numbers, ascending with place, of ranges with about ``group`` pieces: parts of a file, or several files together."""
    file, at = F.shiftright("place", 40), F.col("place").bitwiseAND((1 << 40) - 1)
    told = rows.agg(F.count("*"), F.count_if(F.col("piece") == 0), F.max(file)).first()
    n, docs, files = told[0] or 1, max(1, told[1]), (told[2] or 0) + 1
    span, share = max(1, group * docs // n), max(1, docs // files)  # documents of a range, of a file
    if span > share:
        return F.shiftleft(F.floor(file / (span // share)).cast("long"), _RANGE_BITS)
    return F.shiftleft(file, _RANGE_BITS) + F.least(F.floor(at / span).cast("long"), F.lit((1 << _RANGE_BITS) - 1))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group: int | None = None, place: Column | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of the documents.

    With ``place`` (not negative, ascending along training; see ``stored_place``) sequences are
    numbered along it: each is packed from a short range of places, and rows of one id lie in
    different sequences. Without, pieces are grouped by hash, and sequences have no order.

    Null or empty text, or only white space, is the single id 0. Repeated rows and null ids
    are packed like any others. Texts of any length are tokenized whole. Input columns beside
    id and text are not read, whatever their names. An empty table gives no rows.
    """
    ordered = place is not None
    group = group or (ORDERED_GROUP if ordered else GROUP)
    rows = cut(pieces(docs, tokenizer, id_col, text_col, capacity, place))

    def put(key, table):
        # an order of its own, so that a task run again numbers sequences alike
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("place", "ascending")])
        bins, offsets = pack_lengths(table.column("length").to_numpy(), capacity, _repeated(table.column("id")) if ordered else None)
        if ordered:
            bins, offsets = _ordered(table, bins)
        table = table.append_column("sequence_id", pa.array(bins + (key[0].as_py() << _BIN_BITS))).append_column("offset", pa.array(offsets))
        return table.drop_columns(["group", "place"]).rename_columns([id_col if c == "id" else c for c in table.column_names if c not in ("group", "place")])

    if ordered:
        rows = rows.withColumn("group", _range_of(rows, group))
    else:
        # the number keeps wholly equal rows, however many, from sharing a group; rows are read from the checkpoint, so it stays the same
        rows = rows.withColumn("group", F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(max(1, -(-rows.count() // group)))))
    return rows.groupBy("group").applyInArrow(put, f"`{id_col}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
