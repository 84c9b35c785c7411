import zlib
from collections import defaultdict

import numpy as np
import pytest

from gneiss.llm import packing

from . import samples

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers(whole):
    import random

    r, memo = random.Random(5), packing.WordIds(PATH)
    letters = "aA'sSétÉßİΣς0 1.\n\t\x1c\x85  é中<|endoftext|>\x00ﬁ"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(800)] + [samples.text(i) for i in range(20)] + ["<|endoftext|>", "It's  I'LL\nwe've.", "naïve façade, (test)!!"]
    for t in texts:
        assert np.frombuffer(memo.of(t), "<u4").tolist() == [*whole.encode(t, add_special_tokens=False).ids, 0], repr(t)


def test_places(spark, whole):
    got = packing.pack(samples.docs(spark), PATH, capacity=64, group=50).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"], r["piece"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in bins.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 64
    for i, t, *_ in samples.rows():
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            crc = zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())
            assert any(r["start"] == k and r["length"] == len(ids[k : k + 64]) and r["ids_crc32"] == crc for r in pieces[i, k // 64])
    total = sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in samples.rows())
    assert sum(r["length"] for r in got) == total and len(bins) <= total / 64 * 1.05 + 60
    assert packing.pack(samples.empty(spark), PATH).count() == 0


def test_sum_of_squares_is_tight():
    lengths = np.random.default_rng(1).integers(1, 1200, 4000)
    bins, offsets = packing.pack_lengths(lengths)
    filled = np.zeros(bins.max() + 1, int)
    np.add.at(filled, bins, lengths)
    assert filled.max() <= 2048 and len(filled) <= lengths.sum() / 2048 * 1.005 + 1


def test_each_choice_is_the_smallest_sum_of_squares():
    lengths = np.random.default_rng(2).integers(1, 40, 120)
    bins, _ = packing.pack_lengths(lengths, 50)
    gaps = {}
    for k in np.argsort(-lengths, kind="stable"):
        s, b = int(lengths[k]), int(bins[k])
        cost = lambda g: sum(c * c for c in np.bincount([x for x in g.values() if x], minlength=1))
        open_ = [x for x, g in gaps.items() if g >= s]
        if open_:
            assert b in gaps and cost(gaps | {b: gaps[b] - s}) == min(cost(gaps | {x: gaps[x] - s}) for x in open_)
        gaps[b] = gaps.get(b, 50) - s


def test_sequences_follow_the_order(spark, tmp_path):
    docs = spark.createDataFrame([(i // 3, samples.text(i // 3, 40), i * 7) for i in range(600)], "doc_id bigint, text string, at bigint").orderBy("at")
    docs.write.parquet(path := str(tmp_path / "ordered"))
    stored = spark.read.parquet(path)
    order = [r["at"] for r in stored.orderBy(packing.stored_place(stored)).collect()]
    assert order == sorted(order)
    # every document thrice in a row: copies lie in different sequences, all in order
    got = packing.pack(stored, PATH, capacity=512, group=100, place=packing.stored_place(stored)).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append(r)
    assert all(len({r["doc_id"] for r in v}) == len(v) for v in bins.values()) and max(map(len, bins.values())) > 1
    for v in bins.values():
        at = 0
        for r in sorted(v, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 512
    first = [min(r["doc_id"] for r in bins[b]) for b in sorted(bins)]
    # a range holds some 33 documents; within it copies make up to three passes
    assert all(b >= a - 40 for a, b in zip(first, first[1:], strict=False)) and first[0] == 0 and max(first[-30:]) > 150
    spans = defaultdict(list)
    for r in got:
        spans[r["sequence_id"] >> 24].append(r["doc_id"])
    edges = [(min(v), max(v)) for _, v in sorted(spans.items())]
    assert len(edges) > 4 and all(a[1] <= b[0] for a, b in zip(edges, edges[1:], strict=False))


def test_sequences_are_numbered_by_place(spark):
    docs = spark.createDataFrame([(i, samples.text(i, 30), 1000 - i) for i in range(200)], "doc_id bigint, text string, at bigint")
    from pyspark.sql import functions as F

    got = packing.pack(docs, PATH, capacity=512, place=F.col("at")).collect()
    first = defaultdict(lambda: 10**9)
    for r in got:
        first[r["sequence_id"]] = min(first[r["sequence_id"]], 1000 - r["doc_id"])
    at = [first[b] for b in sorted(first)]
    assert at == sorted(at) and len(at) > 10


def test_wholly_equal_rows_do_not_share_a_group(spark):
    docs = spark.createDataFrame([(None, "")] * 2000, "doc_id bigint, text string").repartition(7)
    groups = defaultdict(int)
    for r in packing.pack(docs, PATH, group=100).collect():
        groups[r["sequence_id"] >> 24] += 1
    assert sum(groups.values()) == 2000 and max(groups.values()) < 200
