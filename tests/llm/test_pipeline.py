"""Each stage on its own input against plain Python, and the whole by its parts."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from gneiss.llm import packing

from . import samples
from .test_native import brute_lines
from .test_ngram_join import brute

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(rows before, rows after) of each stage over the smallest tables."""
    out, docs, root = {}, spark.read.parquet(f"{DATA}/documents.parquet"), tmp_path_factory.mktemp("stages")
    for name, f in cp.STAGES:
        f(spark, docs, DATA).write.parquet(str(root / name))
        after = spark.read.parquet(str(root / name))
        out[name] = docs.collect(), after.collect()
        if name != "packing":
            assert after.columns == docs.columns
        docs = after
    return out


def test_toxicity_leaves_clean_documents(spark, stages):
    before, after = stages["toxicity"]
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert sum(toxic.get(i) == 0 for i in gone) <= 1 and sum(toxic.get(i) == 1 for i in gone) >= 0.6 * sum(v == 1 for v in toxic.values())


def test_lines(stages):
    before, after = stages["line_dedup"]
    want = brute_lines([(r["doc_id"], r["text"]) for r in before])
    assert sorted((r["doc_id"], r["text"]) for r in after) == sorted(w[:2] for w in want)
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_duplicates(stages):
    before, after = stages["ngram_join"]
    want = {w[0] for w in brute([(r["doc_id"], r["text"]) for r in before]) if w[0] == w[2]}
    assert {r["doc_id"] for r in after} == want and len(after) == len(want)


def test_mix_and_pack(stages):
    before, after = stages["mixing"]
    words = lambda rows: sum(len(re.findall(r"\S+", r["text"])) for r in rows)
    assert 0.8 * words(before) < words(after) < 1.2 * words(before) and {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    mixed, packed = stages["packing"]
    whole = defaultdict(int)
    for r in packed:
        whole[r["doc_id"]] += r["length"]
    memo = packing.WordIds(cp.tokenizer_path())
    want = defaultdict(int)
    for r in mixed:
        want[r["doc_id"]] += len(memo.of(r["text"])) // 4
    assert whole == want
    together = [(r["sequence_id"], r["doc_id"]) for r in packed if r["length"] < packing.CAPACITY]
    assert len(together) == len(set(together)) and len(packed) > len({r["doc_id"] for r in packed})  # copies, but never side by side


def test_run_is_its_stages(spark, stages):
    got = cp.run(spark, DATA).drop("sequence_id", "offset").collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r)[:5] for r in stages["packing"][1])


def test_edges(spark):
    for docs in (samples.docs(spark), samples.empty(spark)):
        for name, f in cp.STAGES[:-1]:
            out = f(spark, docs, DATA)
            assert out.columns == docs.columns, name
            n = out.count()
            assert n <= 3 * docs.count()
        assert cp.STAGES[-1][1](spark, docs, DATA).count() >= docs.count()
    kept = cp.drop_near_duplicates(spark, samples.docs(spark), DATA)
    assert kept.filter(F.col("doc_id").isNull()).count() == 2 and kept.filter("doc_id IN (104, 103)").count() == 1
