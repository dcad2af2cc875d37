"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword; for each bit a linear hinge-loss classifier over hashed 3-grams of the lower-cased bytes
is fitted. The codeword of least loss, weighted by how well each bit was learnt, names the language; the score is its
share among the codewords, and a small lead over the second marks the text as ambiguous.

Cases: null texts, and texts without a letter, are `und` with score 0; rows without a language are not learnt from;
without any language to learn all is `und`; with one language all else is that; repeated rows are kept; other columns
are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import fold, release, small_batches, table
from orbweave.llm.linear import byte_grams, dual_descent, sample

#: Rows of each language that the bits are fitted on, about.
SAMPLE = 400
BITS, K, SCALE = 16, 3, 30.0


def codewords(n: int) -> np.ndarray:
    """Exhaustive codes to five languages; beyond, the random dense code of largest least distance of 50 draws."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1, *c] for c in itertools.product((1, -1), repeat=n - 1)][1:]).T
    width = int(np.ceil(10 * np.log2(n)))
    best = None
    for seed in range(50):
        code = np.where(np.random.default_rng(seed).random((n, width)) < 0.5, 1, -1)
        least = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if (np.abs(code.sum(axis=0)) < n).all() and (best is None or least > best[0]):
            best = (least, code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def margins(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), len(self.bias)))
        for lo, hi, x, first in byte_grams(column, BITS, K, 1 << 20):
            n = np.diff(first)
            some = np.flatnonzero(n)
            if len(some):
                sums = np.add.reduceat(self.weight[x], first[:-1][some], axis=0)
                out[lo + some] = SCALE * sums / n[some][:, None]
            out[lo:hi] += self.bias
        return out

    def decode(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest codeword, its share, and the lead over the second."""
        loss = np.logaddexp(0, -2 * margin[:, None, :] * self.code[None]) @ self.trust
        near = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        near /= near.sum(axis=1, keepdims=True)
        order = np.sort(near, axis=1)
        return near.argmax(axis=1), order[:, -1], order[:, -1] - (order[:, -2] if near.shape[1] > 1 else 0)


    def named(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, score and lead of every text; `und`, 0 and 0 without a letter or a learnt language."""
        names = np.array([*self.languages, "und"], object)
        letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.languages:
            return np.full(len(letters), "und", object), np.zeros(len(letters)), np.zeros(len(letters))
        best, share, ahead = self.decode(self.margins(column))
        return names[np.where(letters, best, len(names) - 1)], np.where(letters, share, 0.0), np.where(letters, ahead, 0.0)


def grams(column: pa.Array) -> list[np.ndarray]:
    return [x[a:b] for _, _, x, first in byte_grams(column, BITS, K) for a, b in zip(first, first[1:], strict=False)]


def fit(labelled: DataFrame, label: str = "lang", most: int = SAMPLE, c: float = 10.0) -> Model:
    """labelled(doc_id, text, label): at most about `most` rows of each language are used, each under its own label."""
    labels, x = sample(None, labelled, label, most, grams)
    languages = sorted(set(labels))
    code = codewords(len(languages))
    bits = code.shape[1] if len(languages) else 0
    weight, bias, trust = np.zeros((1 << BITS, bits), np.float32), np.zeros(bits), np.ones(bits)
    if len(languages) == 1:
        bias[:] = 1
    if len(languages) > 1:
        rows = [np.unique(f, return_counts=True) for f in x]
        features, values = [f for f, _ in rows], [SCALE * n / max(n.sum(), 1) for _, n in rows]
        which = np.array([languages.index(v) for v in labels])
        for b in range(bits):
            y = code[which, b]
            cost = c * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
            w = dual_descent(features, values, y, cost, 1 << BITS)
            right = np.mean([y[i] * (w[f] @ v + w[-1]) > 0 for i, (f, v) in enumerate(zip(features, values, strict=True))])
            weight[:, b], bias[b], trust[b] = w[:-1], w[-1], max(right - 0.5, 0.01)
        trust /= trust.sum() / bits
    return Model(languages, code, weight, bias, trust)


def identified(docs: DataFrame, model: Model, lead: float = 0.2) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row of docs; doc_id is any column of long."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS numbers a bit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, share, ahead = held.value.named(b["text"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(best, pa.string()), pa.array(share), pa.array(ahead < lead)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def learnt(docs: DataFrame) -> Model:
    small_batches(docs.sparkSession)
    return fit(docs.where(F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0)).select("doc_id", "text", "lang"))


def known_language(docs: DataFrame) -> DataFrame:
    """docs without the rows whose language can't be told; rows are judged and passed on in one pass over the texts."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(learnt(docs))  # 2 ** BITS numbers a bit
    release(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(held.value.named(b["text"])[0] != "und", pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identified(docs, learnt(docs))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op10_language_ecoc": op10}
ORACLES: dict[str, str] = {}
