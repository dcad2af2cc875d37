"""Core numbers of nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.shared import shared_dir
from orbweave.operators.graph_blocks import Edges, blocks, placed

#: Edges of a block of nodes, on average.
EDGES = 1 << 20


def lowered(now: np.ndarray, u: np.ndarray, far: np.ndarray, inside: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Values of a block's nodes, each replaced by the h-index of its neighbours' values until none changes.

    u are places of the block's nodes, one for each edge; far the values at the other ends, of which those at `inside`
    are in the block, at `place`, and follow it.
    """
    now, near = now.copy(), far.copy()
    while True:
        near[inside] = now[place]
        low = np.bincount(u[near >= now[u]], minlength=len(now)) < now
        if not low.any():
            return now
        own = low[u]
        a, x = u[own], near[own]
        order = np.lexsort((-x, a))
        a, x = a[order], x[order]
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a)))) + 1
        now[a[first]] = np.minimum(now[a[first]], np.maximum.reduceat(np.minimum(x, rank), first))


def core_numbers(spark: SparkSession, adj: DataFrame, path: str | None = None, degrees: DataFrame | None = None) -> DataFrame:
    """(id, core) of a symmetric simple adj(u, v): degrees, replaced by the h-index of the neighbours' values until none
    changes, in any order. path is that of placed() of adj, degrees(id, deg) those of its nodes, if they are there.

    A worker holds the edges of a block of nodes and their neighbours' values and settles the block by itself; only a
    value a node is written between rounds, and rounds are needed only where edges lead from block to block.
    """
    path = path or placed(spark, adj.select("u", "v"))
    start = adj.groupBy("u").agg(F.count("*").alias("v")) if degrees is None else degrees.select(F.col("id").alias("u"), F.col("deg").cast("bigint").alias("v"))
    values = placed(spark, start)
    now = spark.read.parquet(values)
    size = max(1, now.count() * EDGES // max(1, adj.count()))
    while True:

        def run(batches: Iterator[pa.RecordBatch], values: str = values) -> Iterator[pa.RecordBatch]:
            ids = np.sort(np.concatenate([np.empty(0, np.int64), *[b["id"].to_numpy() for b in batches]]))
            if len(ids):
                u, v = Edges(path).of(ids)
                known, x = Edges(values).of(np.union1d(ids, v))
                order = np.argsort(known)
                known, x = known[order], x[order]
                before, to = x[np.searchsorted(known, ids)], np.minimum(np.searchsorted(ids, v), len(ids) - 1)
                inside = np.flatnonzero(ids[to] == v)
                core = lowered(before, np.searchsorted(ids, u), x[np.searchsorted(known, v)], inside, to[inside])
                yield from pa.Table.from_pydict({"u": ids, "v": core, "moved": core < before}).to_batches(1 << 16)

        # Written as placed() would: blocks are ranges of ids, sorted.
        values = shared_dir(spark, "core")
        settled = blocks(spark, now.select(F.col("u").alias("id")), size).mapInArrow(run, "u BIGINT, v BIGINT, moved BOOLEAN")
        settled.write.option("parquet.block.size", 1 << 20).parquet(values)
        now = spark.read.parquet(values)
        if now.where("moved").isEmpty():
            return now.select(F.col("u").alias("id"), F.col("v").alias("core"))
