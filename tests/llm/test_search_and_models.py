import io
import wave
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gneiss.llm import audio, docstats, langid, permutation_index, quality, toxicity
from gneiss.llm.labelled import held_out, sample

from . import samples


def brute_search(rows, k=5, every=50):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            x = np.ldexp(x, -np.frexp(np.abs(x).max())[1])
            fine[i] = x if i not in fine else min(fine[i], x, key=lambda y: y.tolist())
    out = []
    for q in sorted(fine):
        if q % every == 0:
            s = sorted((-float((fine[q] * x).sum() / np.sqrt((x * x).sum()) / np.sqrt((fine[q] ** 2).sum())), i) for i, x in fine.items() if i != q)[:k]
            out += [(q, n + 1, i, pytest.approx(-c)) for n, (c, i) in enumerate(s)]
    return out


def test_neighbours(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(1000, rows[7][1]), (2000, None), (2050, [0.0] * 8), (2100, [1.0] * 7 + [None]), (2150, [float("nan")] * 8), (2200, [1.0] * 9), (None, [1.0] * 8), (2250, [float("inf")] * 8)]
    # one id with several vectors, in the lists of many; and components of any magnitude
    rows += [(7, [-x for x in rows[7][1]]), (74, [x + 1e-3 for x in rows[100][1]]), (74, rows[74][1])]
    rows += [(3000, [x * 1e200 for x in rows[50][1]]), (3001, [x * 1e-200 for x in rows[50][1]]), (3050, [x * 1e-300 for x in rows[3][1]]), (3100, [5e-324] + [0.0] * 7)]
    df = spark.createDataFrame([(*x, 0, 1) for x in rows], "vec_id bigint, embedding array<double>, label int, id int")
    got = permutation_index.search(df, share=1.0).orderBy("query_id", "rank").collect()
    want = brute_search(rows)
    assert [(g["query_id"], g["rank"], g["vec_id"], g["score"]) for g in got] == want and {3000, 3050, 3100} <= {w[0] for w in want}
    near = permutation_index.search(df).collect()
    found = {(g["query_id"], g["vec_id"]) for g in near}
    assert sum((w[0], w[2]) in found for w in want) >= 0.9 * len(want)
    few = permutation_index.search(df.filter("vec_id < 3")).orderBy("rank").collect()
    assert [(g["query_id"], g["rank"]) for g in few] == [(0, 1), (0, 2)]
    assert permutation_index.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [60, 4096])
def test_shards_and_blocks(spark, size, monkeypatch):
    monkeypatch.setattr(permutation_index, "SHARD", size)
    monkeypatch.setattr(permutation_index, "BLOCK", 2)
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = permutation_index.search(df).collect()
    x = df.orderBy("vec_id").collect()
    u = np.array([r["embedding"] for r in x], float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    hits = 0
    for q in range(0, len(x), 50):
        s = u @ u[q]
        s[q] = -9
        hits += len({x[i]["vec_id"] for i in np.argsort(-s)[:5]} & {g["vec_id"] for g in got if g["query_id"] == x[q]["vec_id"]})
    assert hits >= 0.9 * len(got) and len(got) == 5 * len(range(0, len(x), 50))


def _recall(rows, got):
    """By score, so that ties of equal vectors don't count as misses."""
    x = np.array([r["embedding"] for r in rows], float)
    u, ids = x / np.linalg.norm(x, axis=1)[:, None], np.array([r["vec_id"] for r in rows])
    found = {}
    for g in got:
        found.setdefault(g["query_id"], []).append(g["score"])
    hits = n = 0
    for at in np.flatnonzero(ids % 50 == 0):
        s = u @ u[at]
        s[at] = -9
        fifth = np.sort(s)[-5]
        hits += sum(v >= fifth - 1e-12 for v in found[int(ids[at])])
        n += 5
    return hits / n


def test_recall_on_the_larger_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert _recall(df.collect(), permutation_index.search(df).collect()) >= 0.9


def test_recall_with_a_tight_cluster(spark):
    r = np.random.default_rng(9)
    centre = r.normal(size=64)
    rows = [(i, (centre + 0.05 * r.normal(size=64) if i % 3 == 0 else r.normal(size=64)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert _recall([{"vec_id": i, "embedding": v} for i, v in rows], permutation_index.search(df).collect()) >= 0.9


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out) > 100 and all(0 <= r["score"] <= 1 for r in got)
    edge = {(r["doc_id"]): r for r in langid.identify(samples.docs(spark)).collect()}
    assert [edge[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and edge[103]["lang_pred"] != "und"
    assert langid.identify(samples.empty(spark)).count() == 0
    nothing = langid.identify(samples.docs(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


@pytest.mark.parametrize("l1", [langid.L1, 0.4])
def test_language_by_a_plain_loop(l1, monkeypatch):
    """The model's numbers, entry by entry."""
    monkeypatch.setattr(langid, "L1", l1)
    r = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(60):
        at = np.sort(r.choice(40, 8, replace=False)) + (20 if i % 2 else 0)
        rows.append((at, r.integers(1, 5, 8).astype(float)))
        labels.append("b" if i % 2 else "a")
    m = langid.fit(rows, labels)
    assert m.languages == ["a", "b"]
    idf = [np.log(61 / (1 + sum(k in at.tolist() for at, _ in rows))) + 1 for k in range(60)]
    assert np.allclose(m.idf[:60], idf)
    xs = []
    for at, n in rows:
        v = {int(k): (1 + np.log(c)) * idf[k] for k, c in zip(at, n, strict=True)}
        size = np.sqrt(sum(x * x for x in v.values()))
        xs.append({k: x / size for k, x in v.items()})
    z, q = [[[0.0] * 2 for _ in range(60)] for _ in range(2)]
    w = lambda k, c: 0.0 if abs(z[k][c]) <= langid.L1 else -(z[k][c] - np.sign(z[k][c]) * langid.L1) / ((langid.BETA + np.sqrt(q[k][c])) / langid.ALPHA + langid.L2)
    order, learn = np.random.default_rng(7), [i for i in range(60) if i % 5 != 4]
    softmax = lambda s: np.exp(s - np.max(s)) / np.exp(s - np.max(s)).sum()
    for _ in range(langid.EPOCHS):
        for i in order.permutation(np.array(learn)):
            now = {k: [w(k, c) for c in (0, 1)] for k in xs[i]}
            p = softmax(np.array([sum(x * now[k][c] for k, x in xs[i].items()) for c in (0, 1)]))
            p["ab".index(labels[i])] -= 1
            for k, x in xs[i].items():
                for c in (0, 1):
                    g = x * p[c]
                    z[k][c] += g - (np.sqrt(q[k][c] + g * g) - np.sqrt(q[k][c])) / langid.ALPHA * now[k][c]
                    q[k][c] += g * g
    weight = np.array([[w(k, c) for c in (0, 1)] for k in range(60)])
    assert np.allclose(m.weight[:60], weight) and (weight == 0).any() == (l1 == 0.4)
    aside = [i for i in range(60) if i % 5 == 4]
    loss = lambda t: np.mean([-np.log(softmax(np.array([sum(x * weight[k][c] for k, x in xs[i].items()) for c in (0, 1)]) / t)["ab".index(labels[i])]) for i in aside])
    assert loss(m.temperature) <= min(loss(t) for t in np.geomspace(0.02, 5, 80)) + 1e-12


def test_hot_ids_and_many_languages(spark):
    rows = [(5, f"text {i} of the hot row", "en") for i in range(300)] + [(i, f"a few words {i}", "en") for i in range(100, 140)] + [(i, f"ein paar wörter {i}", f"l{i}") for i in range(200, 240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.identify(docs, most_languages=3).collect()
    assert len(got) == len(rows) and len({r["lang_pred"] for r in got}) <= 3
    labels = spark.createDataFrame([(i, i % 2, 0) for i in (5, *range(100, 140))], "doc_id bigint, quality int, toxic int")
    assert quality.score_quality(docs, labels).count() == len(rows)
    chains = [toxicity.train(docs.repartition(n), labels.withColumn("toxic", F.col("doc_id") % 2)) for n in (1, 5)]
    assert len(chains[0].models) == 3 and all(np.allclose(a.weight, b.weight) for a, b in zip(chains[0].models, chains[1].models, strict=True))


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum((r["predicted"] == 1) == (r["quality"] == 1) for r in got) >= 0.95 * len(got) > 40
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)
    edge = quality.score_quality(samples.docs(spark), labels).collect()
    assert len(edge) == len(samples.rows()) and all(0 <= r["score"] <= 1 for r in edge)
    assert quality.score_quality(samples.empty(spark), labels).count() == 0
    none = spark.createDataFrame([(None, None, None)], labels.schema)
    assert {r["score"] for r in quality.score_quality(samples.docs(spark), none).collect()} == {0.5}


def test_trees_flatten():
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit(x, y, trees=40)
    assert ((m.probability(x) > 0.5) == y).mean() > 0.97
    for i in range(5):  # one row, one tree at a time
        s = m.base
        for k in m.roots:
            while m.left[k] != k:
                k = m.left[k] if x[i, m.feature[k]] <= m.threshold[k] else m.right[k]
            s += m.value[k]
        assert m.margin(x[i : i + 1])[0] == pytest.approx(s)


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    part = labels.filter(~held_out(F.col("doc_id")))
    chain = toxicity.train(docs, part)
    assert chain.names == ["junk", "toxic", "toxic_junk"] and len(chain.models[2].weight) == len(chain.models[0].weight) + 2
    got = toxicity.judge(docs, chain).join(labels.filter(held_out(F.col("doc_id"))), "doc_id").collect()
    assert not any(r["is_toxic"] for r in got if r["toxic"] == 0)
    assert sum(r["is_toxic"] for r in got) >= 0.6 * sum(r["toxic"] for r in got) > 0
    clash = samples.docs(spark).withColumn("P_toxic", F.lit("x"))
    out = toxicity.judge(clash, chain)
    assert out.count() == clash.count() and out.columns.count("p_toxic") == 1 and "P_toxic" not in out.columns
    assert toxicity.judge(samples.empty(spark), chain).count() == 0
    none = toxicity.train(docs, labels.filter("toxic = 0"))
    assert not any(r["is_toxic"] for r in toxicity.judge(docs, none).collect())
    assert toxicity.judge(docs, toxicity.train(docs, labels.limit(0))).count() == docs.count()


def test_out_of_fold_inputs():
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 3))
    a = (x[:, 0] > 0).astype(float)
    chain = toxicity.fit_chain(x, {"a": a, "b": a}, np.ones(400), np.zeros(0, np.uint64))
    assert chain.models[1].weight[3] > 0.3 and ((chain.probabilities(x)[:, 1] > 0.5) == a).mean() > 0.95


def test_chain_by_plain_models():
    """Every link by itself: what it is fed and what it is cut at come from models that never saw the row, nor inputs chosen with it."""
    r = np.random.default_rng(6)
    x = r.normal(size=(300, 6)).astype(np.float32)
    ys = {"a": (x[:, 0] + 0.3 * r.normal(size=300) > 0).astype(float), "b": (x[:, 1] > 0.3).astype(float)}
    fold, weight = r.integers(0, toxicity.FOLDS, 300), r.random(300) + 0.5
    columns = [np.array(c) for c in ([0, 4, 5], [1, 4, 5], [0, 1, 4, 5], [2, 4, 5], [0, 1, 3, 4, 5])]
    chain = toxicity.fit_chain(x, ys, weight, np.zeros(4, np.uint64), fold, columns)
    seen = []
    for k, y in enumerate(ys.values()):
        held = np.zeros(300)
        for i in range(300):
            others, at = [j for j in range(300) if fold[j] != fold[i]], columns[fold[i]]
            take = lambda j, at=at: [*x[j, at], *[s[j] for s in seen]]
            if i in (0, 1, 2, 3, 50, 299):
                m = toxicity.fit_linear(np.array([take(j) for j in others]), y[others], weight[others])
                held[i] = m.probability(np.array([take(i)]))[0]
        for f in range(toxicity.FOLDS):  # all of a fold at once
            others, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            z = np.column_stack([x[:, columns[f]], *seen])
            p = toxicity.fit_linear(z[others], y[others], weight[others]).probability(z[own])
            assert all(held[i] in (0, pytest.approx(v, abs=1e-5)) for i, v in zip(own, p, strict=True))
            held[own] = p
        z = np.column_stack([x[:, columns[toxicity.FOLDS]], *seen])
        assert np.allclose(chain.models[k].weight, toxicity.fit_linear(z, y, weight).weight, atol=1e-5)
        f1 = lambda t: 2 * (weight * y)[held >= t].sum() / (weight[held >= t].sum() + (weight * y).sum())  # noqa: E731,B023
        assert f1(chain.thresholds[k]) >= max(f1(t) for t in np.clip(held, 0.3, 0.7)) - 0.02
        seen.append(held)


def test_inputs_are_chosen_without_the_fold(spark):
    """A word that only one fold's toxic rows have is no input of that fold's models."""
    rows = [(i, f"{'plain words here and there ' * 3} {samples.text(i, 20)}" + (" nasty" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(240)]
    docs = spark.createDataFrame(rows, "id bigint, text string, toxic int").withColumn("fold", toxicity._fold(F.col("id")))
    docs = docs.withColumn("text", F.when((F.col("fold") == 1) & (F.col("toxic") == 1), F.concat("text", F.lit(" zzonly"))).otherwise(F.col("text")))
    sets = toxicity._telling(docs.select("id", "text", "toxic", "fold"), ["toxic"])
    word = lambda w: toxicity.inputs(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[1][0]
    assert len(sets) == toxicity.FOLDS + 1 and all(word("nasty") in s for s in sets)
    assert [word("zzonly") in s for s in sets] == [f != 1 for f in range(toxicity.FOLDS + 1)]


def test_sample(spark):
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)] + [(5, 1), (None, 1), (7, None)], "doc_id bigint, toxic int")
    ids, there = sample(labels, "toxic", 100)
    n = {r["y"]: r["count"] for r in ids.groupBy("y").count().collect()}
    assert there == {0: 899, 1: 101} and n == {0: 50, 1: 50}


def test_statistics():
    texts = ["", None, "a", "\n\n", "WORD!! WORD!! WORD!!", samples.text(1), "é" * 9, "x" * 9000]
    x = np.concatenate(list(docstats.of_column(pa.array(texts))))
    assert x.shape == (8, len(docstats.NAMES)) and np.isfinite(x).all()
    v = dict(zip(docstats.NAMES, x[4].tolist(), strict=True))
    assert v["words_all_upper"] == 1 and v["words_end_in_symbol"] == 1 and v["distinct_words"] == pytest.approx(1 / 3) and v["top_word"] == 1
    alone = np.concatenate([np.concatenate(list(docstats.of_column(pa.array([t])))) for t in texts])
    assert np.allclose(x, alone)


def sound(notes, rate=2000):
    x = np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (k / 12) * np.arange(128) / rate) for k in notes]) * 0.5
    with wave.open(b := io.BytesIO(), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((x * 32767).astype("<i2").tobytes())
    return b.getvalue()


def test_audio(spark):
    r = np.random.default_rng(1)
    song, other = r.integers(0, 24, 90).tolist(), r.integers(0, 24, 90).tolist()
    rows = [(0, sound(song)), (1, sound(song)), (2, sound(other[:20] + song)), (3, sound(other)), (4, None), (50, b"junk"), (100, sound(other[:5])), (None, sound(song))]
    got = audio.align(spark.createDataFrame([(*x, "c", 1) for x in rows], "rec bigint, media binary, class string, id int"), "rec", "media")
    out = sorted((tuple(x)[:4] + (round(x["bit_error"], 1),) if x["match_id"] is not None else tuple(x)[:2] for x in got.collect()), key=repr)
    assert out == [(0, 0, 2, 0, 0.0), (0, 2, 1, 40, 0.0), (100, None), (50, None)]
    assert audio.align(spark.createDataFrame([], "rec bigint, media binary"), "rec", "media").count() == 0


def test_fingerprint_by_brute_force():
    frames = np.random.default_rng(2).random((50, 12))
    got = audio.fingerprint(frames)
    assert len(got) == 50 - audio.WIDTH + 1 and len(audio.FILTERS) == 16
    for n, (kind, c, h, w) in enumerate(audio.FILTERS):
        t = (audio.WIDTH - w) // 2
        for s in range(len(got)):
            block = frames[s + t : s + t + w, c : c + h]
            early, late, low, high = block[: w // 2], block[w // 2 :], block[:, : h // 2], block[:, h // 2 :]
            pairs = {
                "levels": (block.sum(), (frames[s + t : s + t + w].sum() - block.sum()) * h / (audio.CLASSES - h)), "halves_in_time": (early.sum(), late.sum()), "halves_in_pitch": (low.sum(), high.sum()),
                "checks": (early[:, : h // 2].sum() + late[:, h // 2 :].sum(), early[:, h // 2 :].sum() + late[:, : h // 2].sum()),
            }
            level = int(np.searchsorted(audio.LEVELS, np.log1p(pairs[kind][0]) - np.log1p(pairs[kind][1])))
            assert (int(got[s]) >> (2 * n)) & 3 == level ^ (level >> 1)
