"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader (proximal, elastic net), then calibrated by a temperature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .labelled import held_out
from .textnum import chunks, mix

#: Rows of each language that the model learns from, at most; a fifth of them calibrates it.
MOST_ROWS = 800
#: Languages that are learned, at most: those of most rows.
MOST_LANGUAGES = 200
BITS, LONGEST = 14, 3
SIZE = 1 << BITS
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 2e-3, 1e-3
_PLACE = mix(np.arange(1, LONGEST + 1, dtype=np.uint64)) | np.uint64(1)


class _Letters:
    """code point -> lower case if a letter, else 0, for all assigned letters; built once a process."""

    table: np.ndarray | None = None

    def get(self) -> np.ndarray:
        if self.table is None:
            self.table = np.zeros(0x33480, np.uint32)
            for c in range(len(self.table)):
                if (x := chr(c)).isalpha():
                    self.table[c] = ord(low) if len(low := x.lower()) == 1 else c
        return self.table


_LETTERS = _Letters()


def grams(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each document's n-gram numbers, with repeats: of letters lower-cased, runs of all else one mark; empty without a letter."""
    table = _LETTERS.get()
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    at = heads[offsets]
    low = table[np.minimum(points, len(table) - 1)] * (points < len(table))
    keep = low > 0
    keep[1:] |= low[:-1] > 0
    keep[at[:-1][at[:-1] < len(keep)]] = True
    z = low[keep].astype(np.uint64) + np.uint64(1)
    at = np.concatenate(([0], np.cumsum(keep)))[at]
    codes, total = [], np.zeros(len(z), np.uint64)
    for n in range(LONGEST):
        total = total[: max(0, len(z) - n)] + z[n:] * _PLACE[n]
        codes.append((mix(total + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out.append(np.concatenate([c[a : max(a, b - n)] for n, c in enumerate(codes)]) if (z[a:b] > 1).any() else np.zeros(0, np.int64))
    return out


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(codes, minlength=SIZE)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weight: np.ndarray
    temperature: float = 1.0

    def inputs(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return x / max(np.linalg.norm(x), 1e-12)

    def probabilities(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        s = self.inputs(at, counts) @ self.weight[at] / self.temperature
        p = np.exp(s - s.max())
        return p / p.sum()


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str]) -> Model:
    """rows: (n-gram numbers, counts). Every fifth row is kept from training for the temperature."""
    languages = sorted(set(labels))
    idf = np.zeros(SIZE)
    for at, _ in rows:
        idf[at] += 1
    idf = np.log((1 + len(rows)) / (1 + idf)) + 1
    model = Model(languages, idf, np.zeros((SIZE, max(1, len(languages)))))
    if len(languages) < 2:
        return model
    y = np.array([languages.index(v) for v in labels])
    aside = np.arange(len(rows)) % 5 == 4
    z, n = np.zeros_like(model.weight), np.zeros_like(model.weight)

    def weight(at):
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(7)
    xs = [model.inputs(*r) for r in rows]
    for _ in range(EPOCHS):
        for i in order.permutation(np.flatnonzero(~aside)):
            at = rows[i][0]
            w = weight(at)
            s = xs[i] @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = xs[i][:, None] * p
            new = n[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(n[at])) / ALPHA * w
            n[at] = new
    model.weight = weight(np.arange(SIZE))
    scores = np.array([xs[i] @ model.weight[rows[i][0]] for i in np.flatnonzero(aside)]).reshape(-1, len(languages))
    if len(scores):

        def loss(t: float) -> float:
            s = scores / t
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), y[aside]]).mean())

        model.temperature = float(min(np.geomspace(0.02, 5, 80), key=loss))
    return model


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = MOST_ROWS, most_languages: int = MOST_LANGUAGES) -> DataFrame:
    """id, held_out, lang_pred, score of each row of ``docs``.

    Learns from at most ``most_rows`` documents of each of the ``most_languages`` languages with
    most rows (ties by name), those with the smallest hashes of their id; none that is held out.
    Null text or text without a letter is ``und`` with score 0; so is everything where no row can
    be learned from. Null ids and null languages are not learned from; of rows that repeat an id
    and language one is, that with the least text. Repeated rows are identified alike, ties go to
    the language first by name. Texts of any length are read whole. Columns beside these three
    are not read, whatever their names. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    may = docs.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    keys = may.select("id", "lang", (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)).alias("turn"))
    # at most most_languages rows
    size = keys.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("id").alias("ids")).orderBy(F.desc("n"), "lang").limit(most_languages)
    size = F.broadcast(cut(size.select(F.col("lang").alias("l"), (2.0 * most_rows / F.col("ids")).alias("share"))))
    # before anything is dealt by language, about twice as many as wanted are left of each
    near = keys.join(size, F.col("lang") == F.col("l")).filter("turn <= share").select("id", "lang", "turn").distinct()
    near = near.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("turn", "id")))
    chosen = F.broadcast(cut(near.filter(F.col("nth") <= most_rows).select(F.col("id").alias("i"), F.col("lang").alias("l"))))
    # at most most_rows * most_languages rows
    learn = may.join(chosen, (F.col("id") == F.col("i")) & (F.col("lang") == F.col("l"))).groupBy("id", "lang").agg(F.min("text").alias("text"))

    def count(batches):
        for batch in batches:
            for first, data, offsets in chunks(batch.column(2)):
                for k, codes in enumerate(grams(data, offsets)):
                    at, counts = counted(codes)
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(first + k, 1) for c in (0, 1)], pa.array([at.astype(np.uint16).tobytes()]), pa.array([counts.astype(np.uint32).tobytes()])], names=["id", "lang", "at", "counts"])

    kind = dict(docs.dtypes)["id"]
    found = learn.mapInArrow(count, f"id {kind}, lang string, at binary, counts binary").orderBy(F.xxhash64("id"), "id", "at").toPandas()
    found = found[found["at"].map(len) > 0]
    rows = [(np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(c, np.uint32).astype(np.float64)) for a, c in zip(found["at"], found["counts"], strict=True)]
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, found["lang"].tolist()))

    def predict(batches):
        m = model.value
        for batch in batches:
            langs, scores = [], []
            for _, data, offsets in chunks(batch.column(1)):
                for codes in grams(data, offsets):
                    if len(codes) and m.languages:
                        p = m.probabilities(*counted(codes))
                        langs.append(m.languages[int(p.argmax())])
                        scores.append(float(p.max()))
                    else:
                        langs.append("und")
                        scores.append(0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    out = docs.select("id", "text").mapInArrow(predict, f"id {kind}, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
