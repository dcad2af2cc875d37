"""Dynamic time warping of degree sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Pairs warped together; what they hold at once is this many rows of one matrix.
TOGETHER = 512


def _filled(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.ones((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def warped(p: list[np.ndarray], q: list[np.ndarray], fp: list[np.ndarray] | None = None, fq: list[np.ndarray] | None = None) -> np.ndarray:
    """Exact distances of pairs of sequences with step cost (larger + 0.5) / (smaller + 0.5) - 1, times the larger frequency
    where given; infinite if one is empty, 0 if both are. A distance needs no cell past its pair's ends, so that shorter pairs are filled up."""
    n, m = np.array([len(x) for x in p]), np.array([len(x) for x in q])
    out = np.where(n == m, 0.0, np.inf)
    some = (n > 0) & (m > 0)
    if not some.any():
        return out
    high, wide = int(n.max()), int(m.max())
    a, b = _filled(p, high) + 0.5, _filled(q, wide) + 0.5
    fa, fb = (_filled(fp, high), _filled(fq, wide)) if fp is not None and fq is not None else (None, None)
    row = np.empty(0)
    for i in range(high):
        cost = np.maximum(a[:, i, None], b) / np.minimum(a[:, i, None], b) - 1
        if fa is not None:
            cost *= np.maximum(fa[:, i, None], fb)
        run = np.cumsum(cost, axis=1)
        if i:
            # left-to-right steps of a row: min over starts of entry cost plus the run of costs after it
            up = np.minimum(row, np.concatenate((np.full((len(row), 1), np.inf), row[:, :-1]), axis=1))
            row = run + np.minimum.accumulate(up - (run - cost), axis=1)
        else:
            row = run
        ends = some & (n == i + 1)
        out[ends] = row[ends, m[ends] - 1]
    return out


def warped_pairs(degrees: np.ndarray, counts: np.ndarray, lengths: np.ndarray, i: np.ndarray, j: np.ndarray, together: int = 2048) -> np.ndarray:
    """Distances of rows i and j of padded compact sequences, none of them empty: a cell of the matrices of all pairs at once."""
    out = np.empty(len(i))
    order = np.lexsort((lengths[j], lengths[i]))
    for at in range(0, len(order), together):
        some = order[at : at + together]
        p, q = i[some], j[some]
        high, wide = lengths[p].max(), lengths[q].max()
        a, fa = (np.ascontiguousarray(x[p, :high].T) for x in (degrees, counts))
        b, fb = (np.ascontiguousarray(x[q, :wide].T) for x in (degrees, counts))
        a, b = a + 0.5, b + 0.5
        row, held = np.empty(b.shape), np.empty(b.shape)
        for k in range(high):
            cost = np.maximum(a[k], b)
            cost /= np.minimum(a[k], b, out=held)
            cost -= 1
            cost *= np.maximum(fa[k], fb, out=held)
            if k == 0:
                np.cumsum(cost, axis=0, out=row)
            else:
                np.minimum(row[1:], row[:-1], out=held[1:])
                np.add(row[0], cost[0], out=row[0])
                for c in range(1, wide):
                    np.minimum(held[c], row[c - 1], out=row[c])
                    np.add(row[c], cost[c], out=row[c])
            ends = np.flatnonzero(lengths[p] == k + 1)
            out[some[ends]] = row[lengths[q[ends]] - 1, ends]
    return out


@F.pandas_udf(DoubleType())
def warping_distance(dp: pd.Series, fp: pd.Series, dq: pd.Series, fq: pd.Series) -> pd.Series:
    """Distance of compact sequences (distinct degrees ascending, and how often each occurs)."""
    out = np.empty(len(dp))
    order = np.argsort(dp.map(len).to_numpy() * 4096 + dq.map(len).to_numpy(), kind="stable")
    for at in range(0, len(order), TOGETHER):
        some = order[at : at + TOGETHER]
        out[some] = warped(*[[np.asarray(s.iloc[i], float) for i in some] for s in (dp, dq, fp, fq)])
    return pd.Series(out, dtype=float)
