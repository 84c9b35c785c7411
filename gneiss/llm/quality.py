"""Quality classifier: histogram gradient-boosted trees over document statistics, as flat arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import docstats
from .common import cut
from .labelled import held_out, sample

#: Labelled rows that the trees learn from, at most.
MOST_ROWS = 20_000
TREES, LEAVES, RATE, BINS, LEAST_ROWS, RIDGE = 120, 12, 0.1, 64, 15, 1.0
PREDICT_FROM = 0.3


class Trees:
    """All nodes of all trees in flat arrays; a leaf points at itself. Rows walk all trees at once."""

    def __init__(self, base: float):
        self.base, self.roots, self.depth = base, [], 1
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def node(self) -> int:
        k = len(self.value)
        self.feature.append(0)
        self.threshold.append(np.inf)
        self.left.append(k)
        self.right.append(k)
        self.value.append(0.0)
        return k

    def freeze(self) -> Trees:
        for name, kind in (("feature", np.int32), ("threshold", np.float32), ("left", np.int32), ("right", np.int32), ("value", np.float64), ("roots", np.int32)):
            setattr(self, name, np.array(getattr(self, name), kind))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _grow(trees: Trees, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> None:
    """One tree, best leaf first; the value of each leaf is added to its rows' margin by the caller."""
    n_features = binned.shape[1]

    def best(rows: np.ndarray) -> tuple[float, int, int]:
        code = (binned[rows] + np.arange(n_features) * BINS).ravel()
        size = n_features * BINS
        sums = [np.bincount(code, weights=None if w is None else np.repeat(w[rows], n_features), minlength=size).reshape(n_features, BINS).cumsum(1) for w in (g, h, None)]
        gl, hl, nl = sums
        gt, ht, nt = (s[:, -1:] for s in sums)
        gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
        gain[(nl < LEAST_ROWS) | (nt - nl < LEAST_ROWS)] = -1
        k = int(gain.argmax())
        return float(gain.flat[k]), k // BINS, k % BINS

    root = trees.node()
    trees.roots.append(root)
    leaves = [(root, np.arange(len(g)), best(np.arange(len(g))), 0)]
    while len(leaves) < LEAVES:
        k = max(range(len(leaves)), key=lambda i: leaves[i][2][0])
        at, rows, (gain, feature, split), depth = leaves[k]
        if gain <= 1e-6:
            break
        goes = binned[rows, feature] <= split
        trees.feature[at], trees.threshold[at] = feature, float(edges[feature][split])
        leaves.pop(k)
        trees.depth = max(trees.depth, depth + 1)
        for side, part in (("left", rows[goes]), ("right", rows[~goes])):
            getattr(trees, side)[at] = child = trees.node()
            leaves.append((child, part, best(part), depth + 1))
    for at, rows, _, _ in leaves:
        trees.value[at] = -RATE * g[rows].sum() / (h[rows].sum() + RIDGE)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = TREES) -> Trees:
    """Boosted trees for the logistic loss. Without both labels the base rate alone."""
    weight = np.ones(len(y)) if weight is None else weight
    rate = (weight * y).sum() / weight.sum() if len(y) else 0.5
    model = Trees(float(np.log(np.clip(rate, 1e-3, 1 - 1e-3) / (1 - np.clip(rate, 1e-3, 1 - 1e-3)))))
    if len(np.unique(y)) < 2:
        return model.freeze()
    edges = []
    for f in range(x.shape[1]):
        e = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1]).astype(np.float32))
        edges.append(np.concatenate((e, np.full(BINS - len(e), np.inf, np.float32))))
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], 1).clip(0, BINS - 1)
    margin = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        first = len(model.value)
        _grow(model, binned, edges, weight * (p - y), weight * p * (1 - p))
        one = Trees(0.0)
        one.feature, one.threshold, one.value = model.feature[first:], model.threshold[first:], model.value[first:]
        one.left, one.right, one.roots, one.depth = [k - first for k in model.left[first:]], [k - first for k in model.right[first:]], [0], model.depth
        margin += one.freeze().margin(x)
    return model.freeze()


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, finger (of the text), x: the statistics of each whole text."""

    def run(batches):
        for batch in batches:
            x = np.concatenate(list(docstats.of_column(batch.column(1)))) if len(batch) else np.zeros((0, len(docstats.NAMES)), np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(docstats.NAMES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, x array<float>")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", most_rows: int = MOST_ROWS) -> DataFrame:
    """id, held_out, score, predicted of each row of ``docs``.

    The trees learn from at most ``most_rows`` labelled documents that are not held out. Null text
    counts as empty; empty texts are scored like any other, texts of any length whole. A null id is
    not held out, and never learned from. Rows that repeat an id are one document to learn from,
    that with the least statistics. Repeated rows get equal scores, and rows of equal statistics
    tie. Without labels, or with one label only, every score is the base rate (0.5 without any).
    Columns beside id and text are not read, whatever their names. An empty table gives no rows.
    """
    rows = cut(statistics(docs, id_col, text_col))
    ids, there = sample(labels, label, most_rows, id_col, ~held_out(F.col(id_col)))
    # the sample has most_rows ids at most, and each gives one row
    learn = rows.join(F.broadcast(ids), F.col("id") == F.col("label_id")).groupBy("id", "y").agg(F.min("x").alias("x")).orderBy(F.xxhash64("id"), "id").toPandas()
    x = np.array(learn["x"].tolist(), np.float32).reshape(len(learn), len(docstats.NAMES))
    y = learn["y"].to_numpy(np.float64)
    share = {k: there[k] / max(1, (y == k).sum()) for k in there}
    weight = np.array([share[int(k)] for k in y])
    model = rows.sparkSession.sparkContext.broadcast(fit(x, y, weight / weight.mean() if len(y) else None))

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(docstats.NAMES))
            parts = [model.value.probability(x[i : i + 4096]) for i in range(0, len(x), 4096)]
            p = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= PREDICT_FROM).astype(np.int32))], names=["id", "score", "predicted"])

    out = rows.mapInArrow(run, "id long, score double, predicted int")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", "predicted")
