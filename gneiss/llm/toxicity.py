"""Toxicity by a chain of linear classifiers.

The categories are predicted one after another; each later model also sees the probabilities of
the earlier ones, in training those of models that have not seen the row (out of fold). Inputs
are counts of telling words and beginnings of words, chosen on the labelled sample, and the
document's statistics. For the models of a fold they are chosen on the other folds, so neither
the probabilities nor the thresholds tuned on them have seen the row's label in any way.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import docstats
from .common import cut
from .labelled import sample
from .textnum import chunks, mix, span_hashes

#: Labelled rows that the chain learns from, at most.
MOST_ROWS = 8_000
#: Telling inputs of a category; documents of the sample that must have one; and its least chi squared, which chance seldom gives.
TELLING, LEAST_DOCS, LEAST_CHI = 250, 4, 10.0
FOLDS, STEPS, RIDGE = 4, 120, 1e-3
#: Bytes of a word's beginnings.
HEADS = (4, 5, 6, 7)

#: Letters: ASCII ones, and every byte of other code points.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def category_columns(quality: str = "quality", toxic: str = "toxic") -> dict[str, Column]:
    """The chain's categories in order, from the two labels there are: junk, toxic, and toxic junk.

    The third is the product of the two before, so its link has little to learn; only ``toxic`` rejects.
    """
    return {"junk": 1 - F.col(quality), "toxic": F.col(toxic), "toxic_junk": (1 - F.col(quality)) * F.col(toxic)}


def _lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, and the capitals among U+00C0 to U+00DE."""
    data = data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    data[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return data


def inputs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each word and each beginning of a word."""
    data = _lowered(data)
    letter = _LETTER[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = ~letter[:-1], ~letter[1:]
    inner = offsets[1:-1]
    before[inner[inner < len(data)]] = True
    after[inner[inner > 0] - 1] = True
    starts, ends = np.flatnonzero(letter & before), np.flatnonzero(letter & after) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    docs, hashes = [doc], [span_hashes(data, starts, ends, lower=False)]
    for n in HEADS:
        long = ends - starts > n
        at = starts[long]
        head = np.zeros(len(at), np.uint64)
        for j in range(n):
            head = (head << np.uint64(8)) | data[at + j].astype(np.uint64)
        docs.append(doc[long])
        hashes.append(mix(head ^ np.uint64(n << 57)))
    return np.concatenate(docs), np.concatenate(hashes)


@dataclass
class Linear:
    """A logistic model of standardised inputs."""

    weight: np.ndarray
    base: float
    mean: np.ndarray
    scale: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.weight + self.base, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> Linear:
    """Accelerated gradient steps on the ridge-penalised logistic loss; one label only gives the base rate."""
    weight = weight / max(weight.sum(), 1e-12)
    rate = float(np.clip((weight * y).sum(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    mean, scale = (x.mean(0), np.maximum(x.std(0), 0.05)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    model = Linear(np.zeros(x.shape[1]), float(np.log(rate / (1 - rate))), mean, scale)
    if len(np.unique(y)) < 2:
        return model
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1).astype(np.float32)
    weight, y = weight.astype(np.float32), y.astype(np.float32)
    v = np.full(z.shape[1], 1 / np.sqrt(z.shape[1]), np.float32)
    for _ in range(15):  # the largest curvature
        v = z.T @ (weight * (z @ v))
        v /= np.linalg.norm(v) + 1e-12
    rate = 1 / (0.25 * float((weight * (z @ v) ** 2).sum()) * 1.1 + ridge)
    w = np.append(np.zeros(x.shape[1]), model.base).astype(np.float32)
    ahead, t = w.copy(), 1.0
    keep = np.append(np.full(x.shape[1], ridge), 0.0).astype(np.float32)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ ahead, -30, 30)))
        new = ahead - np.float32(rate) * (z.T @ (weight * (p - y)) + keep * ahead)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + np.float32((t - 1) / t_new) * (new - w), new, t_new
    model.weight, model.base = w[:-1], float(w[-1])
    return model


@dataclass
class Chain:
    names: list[str]
    telling: np.ndarray  # sorted hashes
    models: list[Linear] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def __post_init__(self):
        # most hashes miss: a table of 2**20 places spares them the search
        self.place = np.zeros(1 << 20, bool)
        self.place[(self.telling >> np.uint64(44)).astype(np.int64)] = True

    def matrix(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, k = len(offsets) - 1, len(self.telling)
        counts = np.zeros((n, k))
        if k:
            doc, hashes = inputs(data, offsets)
            hit = self.place[(hashes >> np.uint64(44)).astype(np.int64)]
            doc, hashes = doc[hit], hashes[hit]
            at = np.minimum(np.searchsorted(self.telling, hashes), k - 1)
            hit = self.telling[at] == hashes
            counts = np.bincount(doc[hit] * k + at[hit], minlength=n * k).reshape(n, k)
        return np.concatenate([np.log1p(counts), docstats.of_chunk(data, offsets)], 1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for m in self.models:
            out = np.concatenate([out, m.probability(np.concatenate([x, out], 1))[:, None]], 1)
        return out


def _threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Of the out-of-fold probabilities, the cut with the best F1, half way to the next value; 0.5 without both labels."""
    if len(np.unique(y)) < 2:
        return 0.5
    order = np.argsort(-p, kind="stable")
    right, all_ = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * right / (all_ + (weight * y).sum())
    k = int(f1.argmax())
    follow = p[order[k + 1]] if k + 1 < len(p) else 0.0
    # where the classes part cleanly any cut between them has the same F1: within these bounds rows unlike any seen stay on the cautious side
    return float(np.clip((p[order[k]] + follow) / 2, 0.3, 0.7))


def fit_chain(x: np.ndarray, ys: dict[str, np.ndarray], weight: np.ndarray, telling: np.ndarray, fold: np.ndarray | None = None, columns: list[np.ndarray] | None = None) -> Chain:
    """Each category's model sees the earlier categories' out-of-fold probabilities.

    ``columns`` are those of x that each fold's models use, then those of the final ones; x has the
    columns of ``telling`` first, and what follows is used by all.
    """
    fold = np.arange(len(x)) % FOLDS if fold is None else fold
    columns = columns or [np.arange(x.shape[1])] * (FOLDS + 1)
    chain = Chain(list(ys), telling)
    seen = np.zeros((len(x), 0))
    for y in ys.values():
        held = np.zeros(len(x))
        for f in range(FOLDS):
            z, of = np.concatenate([x[:, columns[f]], seen], 1), fold == f
            held[of] = fit_linear(z[~of], y[~of], weight[~of]).probability(z[of])
        chain.models.append(fit_linear(np.concatenate([x[:, columns[FOLDS]], seen], 1), y, weight))
        chain.thresholds.append(_threshold(held, y, weight))
        seen = np.concatenate([seen, held[:, None]], 1)
    return chain


def _fold(id_: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), id_), F.lit(FOLDS)).cast("int")


def _telling(rows: DataFrame, names: list[str]) -> list[np.ndarray]:
    """The inputs whose documents are most often in some category (chi squared): for each fold over the rows of the others, then over all."""

    def count(batches):
        for batch in batches:
            ys = [batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(len(names))]
            folds = batch.column(2 + len(names)).to_numpy()
            for first, data, offsets in chunks(batch.column(1)):
                doc, hashes = inputs(data, offsets)
                fold = folds[first + doc]
                order = np.lexsort((doc, fold, hashes))
                doc, hashes, fold = doc[order], hashes[order], fold[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
                doc, hashes, fold = doc[new], hashes[new], fold[new]
                if len(doc):
                    start = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (fold[1:] != fold[:-1]))))
                    n = np.diff([*start.tolist(), len(doc)])
                    per = [np.add.reduceat(y[first + doc].astype(np.int64), start) for y in ys]
                    cols = [pa.array(hashes[start].view(np.int64)), pa.array(fold[start].astype(np.int32)), pa.array(n.astype(np.int64)), *[pa.array(p) for p in per]]
                    yield pa.RecordBatch.from_arrays(cols, names=["hash", "fold", "n", *[f"n_{k}" for k in range(len(names))]])

    per = [f"n_{k}" for k in range(len(names))]
    totals = rows.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names]).collect()
    counts = rows.select("id", "text", *names, "fold").mapInArrow(count, f"hash long, fold int, n long, {', '.join(f'{c} long' for c in per)}")
    # without fold f; no row has the fold FOLDS
    without = [F.sum(F.when(F.col("fold") != f, F.col(c)).otherwise(0)).alias(f"{c}_{f}") for f in range(FOLDS + 1) for c in ("n", *per)]
    counts = counts.groupBy("hash").agg(*without).filter(F.col(f"n_{FOLDS}") >= LEAST_DOCS)
    slots = []
    for f in range(FOLDS + 1):
        of = [r for r in totals if r["fold"] != f]
        for k, name in enumerate(names):
            share = sum(r[name] for r in of) / max(1, sum(r["n"] for r in of))
            if 0 < share < 1:
                expected = F.col(f"n_{f}") * share
                over = F.col(f"n_{k}_{f}") - expected
                slots.append(F.struct(F.lit(f).alias("f"), F.lit(k).alias("k"), F.when((F.col(f"n_{f}") >= LEAST_DOCS) & (over > 0), over * over / expected).alias("chi")))
    chosen = [set() for _ in range(FOLDS + 1)]
    if slots:
        nth = F.row_number().over(W.partitionBy("f", "k").orderBy(F.desc("chi"), "hash"))
        best = counts.select("hash", F.explode(F.filter(F.array(*slots), lambda x: x["chi"] >= LEAST_CHI)).alias("x")).select("hash", "x.*").withColumn("nth", nth)
        for r in best.filter(F.col("nth") <= TELLING).select("f", "hash").collect():  # at most TELLING of each fold and category
            chosen[r["f"]].add(r["hash"])
    return [np.sort(np.array(sorted(c), np.int64).view(np.uint64)) for c in chosen]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: dict[str, Column] | None = None, by: str = "toxic", most_rows: int = MOST_ROWS) -> Chain:
    """A chain from at most ``most_rows`` labelled documents, half of them with the label ``by`` if there are so many.

    Rows that repeat an id are one document, that with the least text; labels that repeat one count
    with the largest. Null ids and null labels ``by`` are not learned from, null text is empty.
    Without both values of a category its probability is the base rate.
    """
    categories = categories or category_columns()
    ids, there = sample(labels, by, most_rows, id_col)
    marks = labels.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("m_id"), *[F.coalesce(c.cast("int"), F.lit(0)).alias(k) for k, c in categories.items()])
    marks = marks.groupBy("m_id").agg(*[F.max(k).alias(k) for k in categories])
    ids = ids.join(marks, F.col("label_id") == F.col("m_id")).drop("m_id")
    # at most most_rows ids: the texts that are not theirs never move
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), F.col("id") == F.col("label_id"))
    rows = rows.groupBy("id", "y", *categories).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = cut(rows.select("id", "text", "y", *categories, _fold(F.col("id")).alias("fold")))
    sets = _telling(rows, list(categories))
    telling = np.unique(np.concatenate(sets))
    blank = Chain(list(categories), telling)

    def turn(batches):
        for batch in batches:
            for first, data, offsets in chunks(batch.column(1)):
                for i, x in enumerate(blank.matrix(data, offsets)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first + i, 1), pa.array([x.astype(np.float32).tobytes()])], names=["id", "x"])

    xs = rows.select("id", "text").mapInArrow(turn, f"id {dict(rows.dtypes)['id']}, x binary").join(rows.drop("text"), "id").orderBy(F.xxhash64("id"), "id").toPandas()
    x = np.array([np.frombuffer(b, np.float32) for b in xs["x"]], np.float32).reshape(len(xs), len(telling) + len(docstats.NAMES))
    y = xs["y"].to_numpy(np.float64)
    share = {k: there[k] / max(1, (y == k).sum()) for k in there}
    weight = np.array([share[int(k)] for k in y])
    rest = np.arange(len(telling), x.shape[1])
    columns = [np.concatenate([np.searchsorted(telling, t), rest]) for t in sets]
    return fit_chain(x, {k: xs[k].to_numpy(np.float64) for k in categories}, weight, sets[FOLDS], xs["fold"].to_numpy(), columns)


def judge(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``p_<category>`` and ``is_<category>`` for each category, replacing columns so named in any case.

    Null text counts as empty, texts of any length are read whole. Null ids are judged like others,
    repeated rows alike; a probability equal to its threshold is in the category. All other columns
    pass through. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = chain.names
    others = [c for c in docs.columns if c.lower() not in {f"{p}_{n}".lower() for p in ("p", "is") for n in names}]

    def probabilities(batches):
        model = shared.value
        for batch in batches:
            text = batch.column(others.index(text_col))
            for first, data, offsets in chunks(text):
                p = model.probabilities(model.matrix(data, offsets))
                own = batch.slice(first, len(offsets) - 1)
                marks = [pa.array(p[:, k]) for k in range(len(names))] + [pa.array(p[:, k] >= model.thresholds[k]) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*own.columns, *marks], names=[*others, *[f"p_{n}" for n in names], *[f"is_{n}" for n in names]])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in docs.select(*[F.col(f"`{c}`") for c in others]).dtypes], *[f"p_{n} double" for n in names], *[f"is_{n} boolean" for n in names]])
    return docs.select(*[F.col(f"`{c}`") for c in others]).mapInArrow(probabilities, schema)
