import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gneiss.llm import ngram_join, trie
from gneiss.llm.components import components, solve
from gneiss.llm.textnum import shingle_sets

from . import samples


def sets_of(rows):
    out = defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", samples.lower(t or ""))
        out[i].append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute(rows, percent=80):
    sets = sets_of(rows)
    up = {i: i for i in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(up)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else root(i)) for i, v in sets.items() for s in v), key=repr)


def near(rows, r):
    """Copies with a few words changed, in a chain and around a hub; and passages that many share."""
    out, base = list(rows), samples.text(999, 120, 3).split(" ")
    for k in range(24):
        w = list(base)
        for _ in range(k % 5):
            w[r.randrange(len(w))] = f"new{r.randrange(1000)}"
        out.append((500 + k, " ".join(w)))
    chain = samples.text(998, 150, 3).split(" ")
    for k in range(8):
        chain[k * 15 : k * 15 + 3] = [f"c{k}x", f"c{k}y", f"c{k}z"]
        out.append((600 + k, " ".join(chain)))
    passage = samples.text(997, 50, 1)
    return out + [(700 + k, f"{passage} {samples.text(2000 + k, 30 if k % 3 else 4, 1)}") for k in range(20)]


@pytest.mark.parametrize("shard", [1024, 3])
def test_join(spark, shard, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHARD_DOCS", shard)
    monkeypatch.setattr(ngram_join, "MINORS", 4 if shard == 3 else 512)
    rows = near([(r[0], r[1]) for r in samples.rows()], random.Random(4))
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id bigint, text string, n int, id int, shard string")
    got = ngram_join.ngram_join(df).collect()
    want = brute(rows)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == want
    assert max(Counter(w[2] for w in want if w[2] is not None).values()) > 10


def test_many_buckets(spark, monkeypatch):
    """More buckets than 16 bits number, and documents outside a block's main component in several chunks."""
    monkeypatch.setattr(ngram_join, "_buckets", lambda grams: 100_000)
    monkeypatch.setattr(ngram_join, "SHARD_DOCS", 4)
    monkeypatch.setattr(ngram_join, "MINORS", 2)
    rows = near([(r[0], r[1]) for r in samples.rows() if len(r[1] or "") < 5000], random.Random(5))
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows)


def test_empty(spark):
    assert ngram_join.ngram_join(samples.empty(spark)).count() == 0
    assert [tuple(r) for r in ngram_join.ngram_join(spark.createDataFrame([(1, None), (2, " ")], "doc_id bigint, text string")).orderBy("doc_id").collect()] == [(1, 0, 1), (2, 0, 2)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 14), min_size=1, max_size=12), min_size=1, max_size=14), st.sampled_from([50, 80, 100]))
def test_trie_finds_all_components(sets, percent):
    links = trie.join([np.array(sorted(s), np.uint64) for s in sets], percent)
    want = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    assert all((max(p), min(p)) in want for p in links)

    def groups(pairs):
        a, b = [p[0] for p in pairs], [p[1] for p in pairs]
        return dict(zip(*(x.tolist() for x in solve(np.array([*a, *range(len(sets))]), np.array([*b, *range(len(sets))]))), strict=True))

    assert groups(links) == groups(want)


def test_shingles_agree_with_words():
    texts = [samples.text(i, 20, 2) for i in range(30)] + ["", None, "a", "A b", "a B", "a b c d e", "A B C D E f", "x\x0by", " lead and trail ", "É é"]
    got, want = list(shingle_sets(__import__("pyarrow").array(texts))), [sets_of([(0, t)])[0][0] for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


@pytest.mark.parametrize("bucket_links", [4, 30, 1000])
def test_components(spark, bucket_links):
    r = random.Random(2)
    pairs = [(r.randrange(90), r.randrange(90)) for _ in range(50)] + [(i, i + 1) for i in range(200, 260)]  # a chain
    pairs += [(500, 600 + i) for i in range(80)] + [(900, 700 + i) for i in range(80)] + [(900, 500), (650, 650)] * 3  # stars around the smallest and the largest
    r.shuffle(pairs)
    frame = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    got = components(frame, bucket_links).collect()
    a, b = zip(*[p for p in pairs if p[0] != p[1]], strict=True)
    want = dict(zip(*(x.tolist() for x in solve(np.array(a), np.array(b))), strict=True))
    assert dict(map(tuple, got)) == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long"), bucket_links).count() == 0
