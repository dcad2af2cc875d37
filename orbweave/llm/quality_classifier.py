"""Naive Bayes support vectors (Wang and Manning, 2012) for document quality.

Words and pairs of words of the whole text are hashed indicators. Each is scaled by its log-count ratio between the
classes, rows are brought to unit length, and a linear hinge-loss model is fitted by dual coordinate descent; a
logistic curve through the margins gives the score.

Cases: null and empty texts get the score of a text without features; rows without a label are scored but never
learnt from; documents with several labels teach each of them; without two classes to learn from every score is the
share of class 1, or 0.5; repeated rows are kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.bytetext import SPACED, words
from orbweave.llm.common import fold, small_batches, table
from orbweave.llm.linear import dual_descent, platt, sample, word_grams

#: Rows of each class that the model is fitted on, about.
SAMPLE = 2500
BITS = 18


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = []
        for w in words(column, SPACED, True):
            row, x = word_grams(w, BITS)
            n = w.hi - w.lo
            length = np.sqrt(np.bincount(row, self.ratio[x] ** 2, n))
            margin = np.bincount(row, self.ratio[x] * self.weight[x], n) / np.maximum(length, 1e-9) + self.bias
            out.append(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def grams(column: pa.Array) -> list[np.ndarray]:
    out = []
    for w in words(column, SPACED, True):
        row, x = word_grams(w, BITS)
        out += np.split(x, np.searchsorted(row, np.arange(1, w.hi - w.lo)))
    return out


def fit(docs: DataFrame, labelled: DataFrame, label: str, most: int = SAMPLE, c: float = 1.0, smooth: float = 1.0, beta: float = 0.25) -> Model:
    """docs(doc_id, text) and labelled(doc_id, label 0/1); at most about `most` rows of each class are used."""
    size = 1 << BITS
    labels, x = sample(docs, labelled, label, most, grams)
    y = np.array([1 if v == "1" else -1 for v in labels])
    if len(set(y)) < 2:
        share = np.clip((y > 0).mean(), 0.01, 0.99) if len(y) else 0.5
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    count = {s: np.full(size, smooth) for s in (1, -1)}
    for s, f in zip(y, x, strict=True):
        count[s][f] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[-1] / count[-1].sum())
    values = [ratio[f] / max(np.linalg.norm(ratio[f]), 1e-9) for f in x]
    cost = c * np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    w = dual_descent(x, values, y, cost, size)
    weight = (1 - beta) * np.abs(w[:-1]).mean() + beta * w[:-1]
    margin = np.array([weight[f] @ v + w[-1] for f, v in zip(x, values, strict=True)])
    slope, offset = platt(margin, y, np.ones(len(y)))
    return Model(ratio.astype(np.float32), weight.astype(np.float32), float(w[-1]), slope, offset)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # two tables of 2 ** BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(held.value.scores(b["text"]), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    small_batches(spark)
    learn = labels.select("doc_id", "quality").where(fold(F.col("doc_id")) != 0)
    found = scored(docs, fit(docs, learn, "quality"))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op2_quality_nbsvm": op2}
ORACLES: dict[str, str] = {}
