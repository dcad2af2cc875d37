"""Sorted heat of nodes over two hops and its distances, found in groups of ranks and not moved."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.shared import ship
from orbweave.operators.graph_blocks import Edges


def profiles(edges: Edges, block: np.ndarray, at_once: int = 256) -> list[np.ndarray]:
    """For every node of the sorted block the values of (1 - s + s^2 / 2) I + (s - s^2) P + s^2 / 2 P P, s = 0.5, in its row,
    in descending order of nine decimals and then by node."""
    u, v, w = edges.of(block, ("u", "v", "w"))
    near = np.unique(v)
    x, y, z = edges.of(near, ("u", "v", "w"))
    (u, v, w), (x, y, z) = ([c[np.argsort(a[0], kind="stable")] for c in a] for a in ((u, v, w), (x, y, z)))
    known = np.unique(np.concatenate((y, near, block)))
    y, v_at, start = np.searchsorted(known, y), np.searchsorted(known, v), np.searchsorted(x, near)
    have = np.searchsorted(x, near, "right") - start
    out: list[np.ndarray] = []
    for part in range(0, len(block), at_once):
        some = block[part : part + at_once]
        lo, hi = np.searchsorted(u, some[0]), np.searchsorted(u, some[-1], "right")
        root, mid = np.searchsorted(some, u[lo:hi]), np.searchsorted(near, v[lo:hi])
        first = 1 / np.sqrt(np.bincount(root, minlength=len(some))[root] * w[lo:hi].astype(float))
        n = have[mid]
        steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[mid], n)
        second = np.repeat(first, n) / np.sqrt(np.repeat(w[lo:hi], n).astype(float) * z[steps])
        rows = np.concatenate((np.arange(len(some)), root, np.repeat(root, n)))
        key = rows * len(known) + np.concatenate((np.searchsorted(known, some), v_at[lo:hi], y[steps]))
        value = np.concatenate((np.full(len(some), 0.625), 0.25 * first, 0.125 * second))
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key, value = key[begin], np.add.reduceat(value, begin)
        order = np.lexsort((key, -np.round(value, 9), key // len(known)))
        out += np.split(value[order], np.searchsorted(key // len(known), np.arange(1, len(some))))
    return out


def profile_distances(spark: SparkSession, path: str, ranked: DataFrame, cells: int = 16) -> DataFrame:
    """(x, y, ks, area) of nodes x and the k nodes after them, of ranked(id, r, k, c): the largest difference of their
    profiles and the sum of differences, place by place as far as both go. path is that of placed() for adj(u, v, w), w
    being the degree of v. A worker finds the profiles of a group of cells and of the cell after it, and keeps no others."""
    ship(spark)
    rows = ranked.withColumn("own", F.floor(F.col("c") / cells)).withColumn("g", F.explode(F.array_distinct(F.array("own", F.floor((F.col("c") - 1) / cells)))))
    rows = rows.repartition("g").sortWithinPartitions("g", "r").select("g", "own", "id", "r", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), pa.schema([(c, pa.int64()) for c in ("g", "own", "id", "r", "k")]))
        g, own, ids, r, k = (t[c].to_numpy() for c in ("g", "own", "id", "r", "k"))
        edges = Edges(path) if len(g) else None
        for one in np.unique(g):
            lo, hi = np.searchsorted(g, one), np.searchsorted(g, one, "right")
            node, rank, mine = ids[lo:hi], r[lo:hi], own[lo:hi] == one
            by = np.argsort(node)
            found = profiles(edges, node[by])
            place = np.empty(len(node), np.int64)
            place[by] = np.arange(len(node))
            long = np.array([len(p) for p in found])[place]
            wide = np.zeros((len(node), long.max()))
            for i, p in enumerate(place):
                wide[i, : long[i]] = found[p]
            for i in np.flatnonzero(mine):
                end = np.searchsorted(rank, rank[i] + k[lo], "right")
                if end <= i + 1:
                    continue
                d = np.abs(wide[i + 1 : end, : long[i]] - wide[i, : long[i]])
                d[np.arange(long[i]) >= long[i + 1 : end, None]] = 0.0
                yield pa.RecordBatch.from_pydict({"x": np.full(len(d), node[i]), "y": node[i + 1 : end], "ks": d.max(1), "area": d.sum(1)})

    return rows.mapInArrow(run, "x BIGINT, y BIGINT, ks DOUBLE, area DOUBLE")
