"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Each shard of vectors posts them, with
their place, in the inverted files of those pivots; a query reads the files of its own pivots,
ranks the shard's vectors by footrule distance of the two orders, and the nearest are reranked by
cosine: of all shards together about RERANK times the square root of the number of vectors, so the
share falls as they grow, besides all whose orders nearly agree. Shards and blocks of queries meet pairwise; the best of all shards win.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Pivots, how many represent a vector, and vectors of the sample that pivots are chosen from for each pivot.
PIVOTS, NEAREST, CHOICE = 256, 64, 4
#: Pivots are no nearer to each other than this cosine, if the sample has so many: a cluster has one, not its share.
APART = 0.7
#: Reranked vectors per square root of all vectors, and the least number of a shard.
RERANK, LEAST = 8.0, 128
#: Vectors whose order agrees with the query's to this share of a full match are all reranked: a tight cluster, within which orders tell little, is searched whole.
CLOSE = 0.45
SHARD, BLOCK = 8192, 4096


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to [0.5, 1): exact, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Unit vectors of the sample, in its order, leaving out those near to one chosen; these follow if there are too few."""
    u, kept, rest = _unit(sample), [], []
    for i in range(len(u)):
        (rest if kept and (u[kept] @ u[i]).max() > APART else kept).append(i)
    return u[(kept + rest)[:pivots]]


def orders(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots, nearest first."""
    return np.argsort(-(_unit(x) @ pivots.T), axis=1, kind="stable")[:, :nearest]


class Shard:
    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, k: int, nearest: int):
        # equal vectors are one entry with its smallest ids: more than k + 1 are never asked for
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]).any(1)
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(x))
        self.ids, self.x, self.k, self.nearest = ids, _scaled(x[self.first]), k, min(nearest, len(pivots))
        self.pivots = pivots
        # a pivot's file is a row: the closeness of its place in each vector's order, 0 where it isn't posted
        self.files = np.zeros((len(pivots), len(self.x)), np.uint8 if self.nearest < 256 else np.uint16)
        self.closeness = np.arange(self.nearest, 0, -1).astype(self.files.dtype)
        self.files[orders(self.x, pivots, self.nearest).T, np.arange(len(self.x))] = self.closeness[:, None]
        self.norm = np.sqrt((self.x * self.x).sum(1))

    def search(self, query: int, q: np.ndarray, share: float) -> list[tuple[int, float]]:
        """(id, cosine) of the k nearest found, ties to smaller ids, without the query's own id."""
        q = _scaled(q[None])[0]
        own = orders(q[None], self.pivots, self.nearest)[0]
        # footrule = constant - 2 * sum over shared pivots of the smaller closeness
        near = np.minimum(self.files[own], self.closeness[:, None]).sum(0, dtype=np.uint32)
        n = min(len(self.x), max(LEAST, int(np.ceil(share * len(self.x)))))
        # those that tie with the last one are reranked too
        last = np.partition(near, len(near) - n)[len(near) - n]
        chosen = np.flatnonzero(near >= min(last, CLOSE * self.nearest * (self.nearest + 1) / 2))
        score = (self.x[chosen] * q).sum(1) / (self.norm[chosen] * np.sqrt((q * q).sum()))
        edge = np.sort(score)[::-1][min(self.k, len(chosen) - 1)]  # one more, as the query itself may be among them
        out = []
        for i, s in zip(chosen[score >= edge].tolist(), score[score >= edge].tolist(), strict=True):
            out += [(int(v), s) for v in self.ids[self.first[i] : self.last[i]][: self.k + 1].tolist() if v != query]
        return sorted(out, key=lambda r: (-r[1], r[0]))[: self.k]


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, pivots: int = PIVOTS, nearest: int = NEAREST, share: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by ``every`` its k nearest found by cosine.

    Vectors take no part if null, zero, with null or non-finite components, of another length
    than most, or with a null id. Rows that repeat an id are one vector: of different ones that
    least by its components in turn. With fewer than k others all are returned. Components of
    any magnitude count. ``share`` of each shard is reranked, RERANK over the square root of the
    number of vectors if not given; ``share=1`` is the exact search. Other columns are not read,
    whatever their names. An empty table gives no rows.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.coalesce(fine, F.lit(False)))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = size["d"] if size else 1
    rows = cut(rows.filter(F.size("v") == d).groupBy("id").agg(F.min("v").alias("v")))
    n = rows.count()
    share = min(1.0, RERANK / max(1.0, n**0.5)) if share is None else share
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(CHOICE * pivots).toPandas()
    table = choose_pivots(np.array(sample["v"].tolist(), np.float64).reshape(-1, d), pivots)
    table = rows.sparkSession.sparkContext.broadcast(table)
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-n // every // BLOCK))
    asked = rows.filter(F.col("id") % every == 0)
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    held = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), numbers(blocks).alias("block"))
    asked = asked.select("id", "v", numbers(shards).alias("shard"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).cast("int").alias("block"))

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return t.column("id").to_numpy(), t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)

    def meet(left, right):
        (ids, x), (qs, qx) = matrix(left), matrix(right)
        out = []
        if len(ids) and len(qs):
            shard = Shard(ids, x, table.value, k, nearest)
            out = [(q, i, s) for q, y in zip(qs.tolist(), qx, strict=True) for i, s in shard.search(q, y, share)]
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    found = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(meet, "query_id long, vec_id long, score double")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
