"""Hashed n-gram indicators of whole texts, bounded training samples and dual coordinate descent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.bytetext import LOWER, SPACED, U, Words, buffers, mixed, slices, windows, words


def word_grams(w: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all words and pairs of words of a row, each once a row; sorted by row.

    Pairs of a word with itself are also features of their own, one for each share of the row's pairs that they pass.
    """
    h = w.hashes()
    pair = windows(h, 2)
    n = np.diff(w.first)
    row = np.repeat(np.arange(len(n)), n)
    inside = np.ones(len(pair), bool)
    inside[w.first[1:-1][(w.first[1:-1] > 0) & (w.first[1:-1] <= len(pair))] - 1] = False
    key = np.concatenate([mixed(h, 1), mixed(pair[inside], 2)]) >> U(64 - bits)
    key |= np.concatenate([row, row[:-1][inside] if len(row) else row]).astype(U) << U(bits)
    twice = np.bincount(row[:-1][inside & (h[1:] == h[:-1])], minlength=len(n)) if len(row) else n
    for j, share in enumerate((0, 1 / 64, 1 / 16, 1 / 4)):
        over = np.flatnonzero(twice > share * np.maximum(n - 1, 0)).astype(U)
        key = np.append(key, over << U(bits) | mixed(np.full(1, 1000 + j, U), 3) >> U(64 - bits))
    key = np.unique(key)
    return (key >> U(bits)).astype(np.int64), (key & U((1 << bits) - 1)).astype(np.int64)


def byte_grams(column: pa.Array, bits: int, k: int, most: int = 3 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi with the hashed k-grams of their lower-cased bytes, a blank before and after: (lo, hi, features, first)."""
    data, offsets = buffers(column)
    for lo, hi in slices(offsets, most):
        at = offsets[lo : hi + 1] - offsets[lo]
        n = hi - lo
        own = np.full(len(data[offsets[lo] : offsets[hi]]) + 2 * n, 0x20, np.uint8)
        put = np.ones(len(own), bool)
        first = at + 2 * np.arange(n + 1)
        put[first[:-1]] = False
        put[first[1:] - 1] = False
        own[put] = LOWER[data[offsets[lo] : offsets[hi]]]
        own[~SPACED[own]] = 0x20
        wide = own.astype(np.uint32)
        m = len(own) - k + 1
        if m <= 0:
            yield lo, hi, np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
            continue
        h = wide[:m].copy()
        for j in range(1, k):
            h = h * np.uint32(257) + wide[j : j + m]
        h = (h * np.uint32(2654435761)) >> np.uint32(32 - bits)
        # Of each row its own k-grams only.
        keep = np.ones(m, bool)
        for j in range(1, k):
            x = first[1:] - j
            keep[x[(x >= 0) & (x < m)]] = False
        count = np.concatenate([[0], np.cumsum(keep)])
        yield lo, hi, h[keep].astype(np.int64), count[np.minimum(first, m)]


def sample(docs: DataFrame | None, labelled: DataFrame, label: str, most: int, extract: Callable[[pa.Array], list[np.ndarray]]) -> tuple[list[str], list[np.ndarray]]:
    """About `most` rows of each label of labelled(doc_id, label), with the features of their texts, on the driver.

    The texts are those of docs(doc_id, text) with the same doc_id, or, without docs, those of labelled's own rows.
    A row is in if the hash of its doc_id is below the label's share, so that reruns agree and the sample is bounded;
    only its ids meet the texts. Null texts and labels are left out.
    Without docs, rows that repeat teach each; partitions reach the driver one by one.
    """
    own = [F.col("text")] if docs is None else []
    rows = labelled.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("string").alias("label"), *own)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, int(min(1.0, most / n) * 2**31))])
    rows = rows.withColumn("o", F.xxhash64("doc_id", F.lit(5))).where(F.pmod("o", F.lit(2**31)) < share[F.col("label")])
    if docs is not None:
        texts = docs.select(F.col("doc_id").alias("id"), "text")
        rows = texts.join(F.broadcast(rows.distinct()), F.col("id") == F.col("doc_id"))  # about `most` ids a label
    rows = rows.where("text IS NOT NULL")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["o"], b["label"], pa.array([x.astype(np.int32).tobytes() for x in extract(b["text"])], pa.binary())], names=["o", "label", "x"])

    got = sorted((r["o"], r["label"], bytes(r["x"])) for r in rows.select("o", "label", "text").mapInArrow(read, "o long, label string, x binary").toLocalIterator())
    return [r[1] for r in got], [np.frombuffer(r[2], np.int32) for r in got]


def dual_descent(x: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Weights of the L2-regularised hinge-loss model by dual coordinate descent (Hsieh et al., 2008).

    x: features of each row; values: their values; cost: the bound of each row's dual variable; the last weight is the bias.
    """
    w = np.zeros(size + 1)
    alpha = np.zeros(len(x))
    norm = np.array([float(v @ v) + 1 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(x)):
            g = y[i] * (w[x[i]] @ values[i] + w[-1]) - 1
            p = min(g, 0) if alpha[i] == 0 else max(g, 0) if alpha[i] == cost[i] else g
            most = max(most, abs(p))
            if p:
                old = alpha[i]
                alpha[i] = min(max(old - g / norm[i], 0), cost[i])
                step = (alpha[i] - old) * y[i]
                w[x[i]] += step * values[i]
                w[-1] += step
        if most < 0.01:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, by Newton's method on smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.stack([margin, np.ones_like(margin)])
    a = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -30, 30)))
        grad = z @ (weight * (p - target))
        step = np.linalg.solve((z * (weight * p * (1 - p))) @ z.T + 1e-6 * np.eye(2), grad)
        a -= step
        if np.abs(step).max() < 1e-6:
            break
    return float(a[0]), float(a[1])
