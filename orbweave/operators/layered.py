"""The layered context graph: warped distances of layers, weights, and random walks that climb between layers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.shared import shared_dir, ship
from orbweave.operators.graph_blocks import Edges, Ranks, blocks
from orbweave.operators.warping import warped_pairs

#: Probability that a step of a walk goes to a neighbour of its layer, not to another layer.
STAY = 0.3
LAYERS = 3


def _compact(root: np.ndarray, degree: np.ndarray, roots: int) -> tuple[pa.Array, pa.Array]:
    """Lists of the distinct degrees of every root, ascending, and of how often each occurs."""
    wide = int(degree.max(initial=0)) + 1
    key, count = np.unique(root * wide + degree, return_counts=True)
    ends = np.searchsorted(key, np.arange(roots + 1) * wide).astype(np.int32)
    return tuple(pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key % wide, count))


def rings(spark: SparkSession, path: str, nodes: DataFrame, together: int = 4096, at_once: int = 512) -> DataFrame:
    """(id, g0, f0, g1, f1, g2, f2): the compact degree sequences of the nodes at distances 0, 1 and 2, empty where there are none.

    path is that of placed() for adj(u, v, w), w being the degree of v. A worker reads the edges of a block of nodes and of
    their neighbours; pairs at distance 2 live in it for `at_once` nodes at a time and are not moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.sort(np.concatenate([np.empty(0, np.int64), *[b["id"].to_numpy() for b in batches]]))
        edges = Edges(path) if len(ids) else None
        for at in range(0, len(ids), together):
            block = ids[at : at + together]
            u, v, w = edges.of(block, ("u", "v", "w"))
            near = np.unique(v)
            x, y, z = edges.of(near, ("u", "v", "w"))
            by = np.argsort(x, kind="stable")
            x, y, z = x[by], y[by], z[by]
            known = np.unique(np.concatenate((y, near, block)))
            y, degree = np.searchsorted(known, y), np.zeros(len(known), np.int64)
            degree[y] = z
            start = np.searchsorted(x, near)
            have = np.searchsorted(x, near, "right") - start
            by = np.argsort(u, kind="stable")
            u, v, w = u[by], v[by], w[by]
            for part in range(0, len(block), at_once):
                some = block[part : part + at_once]
                lo, hi = np.searchsorted(u, some[0]), np.searchsorted(u, some[-1], "right")
                root, mid = np.searchsorted(some, u[lo:hi]), np.searchsorted(near, v[lo:hi])
                n = have[mid]
                steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[mid], n)
                two = np.sort(np.repeat(root, n) * len(known) + y[steps])
                two = two[np.concatenate(([True], two[1:] != two[:-1]))] if len(two) else two
                # A neighbour and the node itself are their neighbours' neighbours at most.
                less = np.concatenate((root * len(known) + np.searchsorted(known, v[lo:hi]), np.arange(len(some)) * len(known) + np.searchsorted(known, some)))
                two = two[~np.isin(two, less)]
                own = np.bincount(root, minlength=len(some))
                columns = []
                for r, d in ((np.arange(len(some)), own), (root, w[lo:hi]), (two // len(known), degree[two % len(known)])):
                    columns += _compact(r, d, len(some))
                yield pa.RecordBatch.from_arrays([pa.array(some), *columns], names=["id", "g0", "f0", "g1", "f1", "g2", "f2"])

    return blocks(spark, nodes, together).mapInArrow(run, "id BIGINT, " + ", ".join(f"g{k} ARRAY<INT>, f{k} ARRAY<INT>" for k in range(LAYERS)))


def _padded(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    ends, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    n = np.diff(ends)
    out = np.ones((len(n), int(n.max(initial=0))))
    out[np.arange(out.shape[1]) < n[:, None]] = flat[ends[0] : ends[-1]]
    return out, n


def dealt(spark: SparkSession, ranked: DataFrame, sequences: DataFrame, cells: int, before: int, after: int) -> DataFrame:
    """Nodes of ranked(id, r, k, c) with their sequences, in groups g of `cells` cells of ranks with the cells up to `before`
    before them and `after` after them; own is the group of a node's own cell."""
    ship(spark)
    of = lambda c: F.floor(c / cells)
    rows = ranked.join(sequences, "id").withColumn("own", of(F.col("c"))).withColumn("g", F.explode(F.sequence(of(F.col("c") - after), of(F.col("c") + before))))
    return rows.repartition("g").sortWithinPartitions("g", "r").select("g", "own", "id", "r", "k", *[c for c in sequences.columns if c != "id"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one g each, of sorted rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        g = b["g"].to_numpy()
        ends = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1), len(g)] if len(g) else [0]
        for lo, hi in zip(ends, ends[1:]):
            if held and held[0]["g"][0].as_py() != g[lo]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t[c].chunk(0).to_numpy() for c in names]


def _warped(t: pa.Table, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places i < j of the pairs of a group that wanted(i, j) takes, and their distances in every layer, nan where one has none."""
    r, k = _columns(t, "r", "k")
    n = np.searchsorted(r, r + k, "right") - np.arange(len(r)) - 1
    i = np.repeat(np.arange(len(r)), n)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + i + 1
    some = wanted(i, j)
    i, j = i[some], j[some]
    c = np.full((LAYERS, len(i)), np.nan)
    for d in range(LAYERS):
        (g, have), (f, _) = _padded(t[f"g{d}"].chunk(0)), _padded(t[f"f{d}"].chunk(0))
        met = np.flatnonzero((have[i] > 0) & (have[j] > 0))
        c[d, met] = warped_pairs(g, f, have, i[met], j[met])
    return i, j, c


def layer_gaps(spark: SparkSession, ranked: DataFrame, sequences: DataFrame, both: bool = False, cells: int = 32) -> DataFrame:
    """(x, y, d, c, f) of pairs of nodes x and the k nodes after them, of ranked(id, r, k, c): the warped distance c of the
    compact degree sequences at distance d, for the layers that both have, and f, the sum of c up to layer d. With `both`
    every pair stands both ways, (u, v, d, f, total), and total is that of exp(-f) over all v of a u and d.

    Nodes are dealt in groups of `cells` cells of ranks with the cells beside them; pairs are formed and warped there.
    """

    def pairs_of(t: pa.Table) -> pa.RecordBatch:
        ids, own, g = _columns(t, "id", "own", "g")
        own = own == g
        i, j, c = _warped(t, lambda i, j: own[i] | own[j] if both else own[i])
        d, p = np.nonzero(~np.isnan(c))
        far = np.cumsum(np.nan_to_num(c), axis=0)[d, p]
        if not both:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[i[p]], ids[j[p]], d.astype(np.int32), c[d, p], far)], names=["x", "y", "d", "c", "f"])
        d, u, v, far = np.tile(d, 2), np.concatenate((i[p], j[p])), np.concatenate((j[p], i[p])), np.tile(far, 2)
        d, u, v, far = (x[own[u]] for x in (d, u, v, far))
        total = np.bincount(d * len(ids) + u, np.exp(-far), LAYERS * len(ids)).astype(float)[d * len(ids) + u]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[u], ids[v], d.astype(np.int32), far, total)], names=["u", "v", "d", "f", "total"])

    rows = dealt(spark, ranked, sequences, cells, int(both), 1)
    return rows.mapInArrow(lambda batches: map(pairs_of, _groups(batches)), "u BIGINT, v BIGINT, d INT, f DOUBLE, total DOUBLE" if both else "x BIGINT, y BIGINT, d INT, c DOUBLE, f DOUBLE")


def kept_gaps(spark: SparkSession, ranked: DataFrame, sequences: DataFrame, cells: int = 32) -> str:
    """Writes (r, id, f, s, n), ascending by rank in row groups of about a megabyte, and returns the folder: f holds for each layer
    the summed distances up to it from the node of rank r to the nodes after it, nan where there is none; s and n are the
    sums and numbers of the weights of each layer. Pairs are warped once and a pair takes 8 bytes a layer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            ids, r, own, g = _columns(t, "id", "r", "own", "g")
            own = own == g
            i, _, c = _warped(t, lambda i, j: own[i])
            f = np.cumsum(c, axis=0)
            w = np.exp(-f)
            have = ~np.isnan(w)
            mine = np.flatnonzero(own)
            per = np.bincount(i, minlength=len(ids))[mine]
            d = np.tile(np.arange(LAYERS)[:, None], len(i))
            by = np.lexsort((d.ravel(), np.tile(i, LAYERS)))
            sums, counts = (np.stack([np.bincount(i, x, len(ids))[mine] for x in y], axis=1).ravel() for y in (np.where(have, w, 0), have))
            ends = lambda n: np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            fixed = ends(np.full(len(mine), LAYERS))
            lists = [pa.ListArray.from_arrays(ends(per * LAYERS), pa.array(f.ravel()[by])), pa.ListArray.from_arrays(fixed, pa.array(sums.astype(float))), pa.ListArray.from_arrays(fixed, pa.array(counts.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([pa.array(r[mine]), pa.array(ids[mine]), *lists], names=["r", "id", "f", "s", "n"])

    path = shared_dir(spark, "layers")
    rows = dealt(spark, ranked, sequences, cells, 0, 1).mapInArrow(run, "r BIGINT, id BIGINT, f ARRAY<DOUBLE>, s ARRAY<DOUBLE>, n ARRAY<BIGINT>")
    rows.write.option("parquet.block.size", 1 << 20).option("compression", "zstd").parquet(path)
    return path


def layer_means(kept: DataFrame) -> list[float]:
    """The mean weight of every layer of kept_gaps(), nan where it has no pair."""
    sums = kept.agg(*[F.sum(F.col(c)[d]).alias(f"{c}{d}") for c in "sn" for d in range(LAYERS)]).head()
    return [sums[f"s{d}"] / sums[f"n{d}"] if sums[f"n{d}"] else math.nan for d in range(LAYERS)]


def weights(far: DataFrame) -> DataFrame:
    """(u, v, d, w): both directions of every pair in every layer, w = exp(-f)."""
    return far.select(F.explode(F.array(F.struct(F.col("x").alias("u"), F.col("y").alias("v")), F.struct(F.col("y").alias("u"), F.col("x").alias("v")))).alias("e"), "d", F.exp(-F.col("f")).alias("w")).select("e.u", "e.v", "d", "w")


def gamma(w: DataFrame) -> DataFrame:
    """(d, u, gamma): neighbours of u in layer d above the layer's mean weight."""
    mean = w.groupBy("d").agg(F.avg("w").alias("m"))
    return w.join(mean, "d").groupBy("d", "u").agg(F.sum(F.when(F.col("w") > F.col("m") + 1e-9, 1).otherwise(0)).cast("bigint").alias("gamma"))


def _draws(names: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.md5(x.encode()).digest()[:4] for x in names), ">u4") / 4294967296.0


class Layers:
    """Neighbours of the nodes of a group in every layer, ascending by id, with running weights, and the chances to climb."""

    def __init__(self, t: pa.Table, means: list[float]) -> None:
        """t is of neighbouring ranks, ascending, of kept_gaps(); what stands after its last node is left out."""
        (self.ids,) = _columns(t, "id")
        f = t["f"].chunk(0)
        n = np.diff(np.asarray(f.offsets)) // LAYERS
        i = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        # A node's layers stand one after the other.
        at = np.repeat((np.cumsum(n) - n) * LAYERS, n) + place
        flat, j = f.flatten().to_numpy(), i + place + 1
        some = j < len(n)
        w = np.exp(-np.stack([flat[(at + d * np.repeat(n, n))[some]] for d in range(LAYERS)]))
        i, j = i[some], j[some]
        by = np.lexsort((self.ids[np.concatenate((j, i))], np.concatenate((i, j))))
        u, v = np.concatenate((i, j))[by], np.concatenate((j, i))[by]
        shape = LAYERS, len(self.ids), int(np.bincount(u, minlength=1).max())
        self.next, self.upto = np.zeros(shape, np.int32), np.zeros(shape)
        self.have, gamma = np.zeros(shape[:2], np.int64), np.zeros(shape[:2], np.int64)
        for d in range(LAYERS):
            x = np.tile(w[d], 2)[by]
            at = np.flatnonzero(~np.isnan(x))
            n = np.bincount(u[at], minlength=len(self.ids))
            place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            self.next[d, u[at], place], self.upto[d, u[at], place], self.have[d] = v[at], x[at], n
            gamma[d] = np.bincount(u[at], x[at] > means[d] + 1e-9, len(self.ids))
        np.cumsum(self.upto, axis=2, out=self.upto)
        self.top = (self.have > 0).sum(axis=0) - 1
        self.climb = np.log(gamma + math.e) / (np.log(gamma + math.e) + 1)

    def walked(self, now: np.ndarray, turn: int, steps: int) -> np.ndarray:
        """Ids on the paths of walks from the nodes at places `now`."""
        walk = [f"layer:{x}:{turn}" for x in self.ids[now].tolist()]
        layer, path = np.zeros(len(now), np.int64), [now]
        for k in range(1, steps + 1):
            changes = np.floor(np.log(np.maximum(_draws([f"{x}:{k}" for x in walk]), 1e-10)) / math.log(1 - STAY))
            for i in range(1, int(changes.max(initial=0)) + 1):
                some = np.flatnonzero(changes >= i)
                up = _draws([f"{walk[x]}:{k}:{i}" for x in some.tolist()]) <= self.climb[layer[some], now[some]]
                layer[some] = np.where(up, np.minimum(layer[some] + 1, self.top[now[some]]), np.maximum(layer[some] - 1, 0))
            upto, last = self.upto[layer, now], self.have[layer, now] - 1
            over = upto > (_draws([f"{x}:{k}:to" for x in walk]) * upto[np.arange(len(now)), last])[:, None]
            # Where rounding leaves none above the goal, the last one.
            now = self.next[layer, now, np.where(over.any(axis=1), over.argmax(axis=1), last)].astype(np.int64)
            path.append(now)
        return self.ids[np.stack(path, axis=1)]


def layered_walks(spark: SparkSession, path: str, steps: int = 10, turns: int = 1, cells: int = 128, at_once: int = 4096) -> DataFrame:
    """(walk, turn, path): `turns` walks of `steps` steps from every node, from layer 0. path is that of kept_gaps().

    Before a step a walk changes layers as often as draws below STAY take to come; each change climbs with the node's
    chance in its layer where there is a layer above, or else descends where there is one below. The step then goes to a
    neighbour in the layer by weight. Draws are hashes of walk, turn, step and change.

    A step goes to one of the k ranks before or after, so that the ranks of `cells` times k nodes with `steps` times k on
    either side hold all that their walks can meet: a worker reads these, and neither layers nor walks are moved.
    """
    kept = spark.read.parquet(path)
    means = layer_means(kept)
    last, k = (x or 0 for x in kept.agg(F.max("r"), F.max(F.size("f"))).head())
    wide, far = max(1, cells * (k // LAYERS)), steps * (k // LAYERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [g for b in batches for g in b["id"].to_pylist()]
        kept = Ranks(path) if groups else None
        for g in groups:
            t = kept.between(g * wide - far, (g + 1) * wide - 1 + far, ("r", "id", "f"))
            (r,) = _columns(t, "r")
            starts = np.flatnonzero(r // wide == g)
            layers = Layers(t, means)
            for at in range(0, len(starts), at_once):
                for turn in range(turns):
                    paths = layers.walked(starts[at : at + at_once], turn, steps)
                    ends = np.arange(len(paths) + 1, dtype=np.int32) * paths.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(paths[:, 0]), pa.array(np.full(len(paths), turn, np.int32)), pa.ListArray.from_arrays(ends, pa.array(paths.ravel()))], names=["walk", "turn", "path"])

    groups = last // wide + 1 if last else 0
    return spark.range(0, groups, 1, max(1, groups)).mapInArrow(run, "walk BIGINT, turn INT, path ARRAY<BIGINT>")
