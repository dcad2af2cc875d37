"""Nearest vectors of queries among those of other folds, exact: blocks of queries pass over all vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from orbweave.functions.shared import shared_dir, ship
from orbweave.operators.graph_blocks import blocks, files

#: Queries of a block; vectors compared with it at once; distances that a rounding to five decimals may make equal.
QUERIES, VECTORS, SLACK = 512, 4096, 2e-5


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    """Rows of vectors; not a number where one is null, of another length or has a null."""
    out = np.full((len(column), dim), np.nan)
    for i, x in enumerate(column):
        if x is not None and len(x) == dim:
            out[i] = np.asarray(x, float)
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed first to last."""
    s = np.zeros(len(a))
    for k in range(a.shape[1]):
        s += (a[:, k] - b[:, k]) * (a[:, k] - b[:, k])
    return np.where(np.isnan(s), np.inf, s)


def _needed(d: np.ndarray, ids: np.ndarray, folds: np.ndarray, own: np.ndarray, top: int) -> tuple[np.ndarray, float]:
    """Which of the vectors found so far may be among the `top` of another fold in some turn, and the distance beyond which
    none is. Of vectors at one distance, such as copies, those of the least ids are enough."""
    order = np.lexsort((ids, d))
    d, folds, far = d[order], folds[order], 0.0
    first = np.maximum.accumulate(np.where(np.concatenate(([True], d[1:] != d[:-1])), np.arange(len(d)), 0))
    kept = np.zeros(len(d), bool)
    for t in range(folds.shape[1]):
        other = folds[:, t] != own[t]
        count = np.cumsum(other)
        kept |= other & (count - (count[first] - other[first]) <= top)
        at = np.searchsorted(count, top)
        far = max(far, d[at]) if at < len(d) else np.inf
    return order[kept & (d <= far + SLACK)], far


def nearest_of_other_folds(spark: SparkSession, vectors: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """(q, b, d) of vectors(id, x, folds) and queries(id): for each turn, place t of folds, every vector that may be among the
    `top` nearest whose fold is not the query's, and d its squared distance, infinite where a vector is null.

    Rows found are as many as queries, a few each. A worker holds a block of queries and a batch of vectors and reads all
    vectors once a block; nothing but ids is moved.
    """
    ship(spark)
    path = shared_dir(spark, "vectors")
    vectors.write.parquet(path)

    def batches() -> Iterator[pd.DataFrame]:
        for f in files(path):
            for b in f.iter_batches(batch_size=VECTORS, use_threads=False):
                yield b.to_pandas()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = np.sort(np.concatenate([np.empty(0, np.int64), *[p["id"].to_numpy() for p in parts]]))
        for at in range(0, len(ids), QUERIES):
            block = ids[at : at + QUERIES]
            mine = pd.concat([b[b["id"].isin(block)] for b in batches()])
            dim = max((len(x) for x in mine["x"] if x is not None), default=0)
            a, qs, own = _matrix(mine["x"], dim), mine["id"].to_numpy(), np.vstack(mine["folds"].to_numpy())
            found = [(np.empty(0), np.empty(0, np.int64), np.empty((0, own.shape[1]), own.dtype)) for _ in qs]
            limit, length = np.full(len(qs), np.inf), (a * a).sum(1)
            for b in batches():
                x, bs, folds = _matrix(b["x"], dim), b["id"].to_numpy(), np.vstack(b["folds"].to_numpy())
                size = (x * x).sum(1)
                about = length[:, None] + size - 2 * (a @ x.T)
                # The product form is off by rounding, in proportion to the lengths.
                near = ~(about > limit[:, None] + SLACK + 1e-9 * (length[:, None] + size))
                near &= bs != qs[:, None]
                for i in np.flatnonzero(near.any(1)):
                    j = np.flatnonzero(near[i])
                    d = _exact(np.broadcast_to(a[i], (len(j), dim)), x[j])
                    d, b_, f = (np.concatenate(z) for z in zip(found[i], (d, bs[j], folds[j]), strict=True))
                    kept, limit[i] = _needed(d, b_, f, own[i], top)
                    found[i] = d[kept], b_[kept], f[kept]
            yield pd.DataFrame({"q": np.repeat(qs, [len(f[0]) for f in found]), "b": np.concatenate([f[1] for f in found]), "d": np.concatenate([f[0] for f in found])})

    return blocks(spark, queries, QUERIES).mapInPandas(run, "q BIGINT, b BIGINT, d DOUBLE")
