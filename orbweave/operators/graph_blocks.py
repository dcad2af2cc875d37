"""The graph as sorted files of the shared folder, of which an Arrow worker reads the parts that its nodes reach."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from orbweave.functions.shared import shared_dir, ship


def placed(spark: SparkSession, adj: DataFrame) -> str:
    """Writes adj(u, v, ..), both directions, sorted by (u, v) in row groups of about a megabyte, and returns the folder."""
    ship(spark)
    path = shared_dir(spark, "graph")
    adj.repartitionByRange("u").sortWithinPartitions("u", "v").write.option("parquet.block.size", 1 << 20).parquet(path)
    return path


def files(path: str) -> list:
    """The Parquet files of a folder that Spark wrote, by name."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    names = sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.endswith(".parquet"))
    return [pq.ParquetFile(system.open_input_file(n)) for n in names]


class Edges:
    """Edges of given nodes from the files of placed(); row groups without any of them are not read."""

    def __init__(self, path: str) -> None:
        self.files = files(path)
        self.groups = []
        for f in self.files:
            for g in range(f.metadata.num_row_groups):
                s = f.metadata.row_group(g).column(0).statistics
                if s is not None and s.has_min_max:
                    self.groups.append((f, g, s.min, s.max))
                elif f.metadata.row_group(g).num_rows:
                    self.groups.append((f, g, None, None))

    def of(self, nodes: np.ndarray, columns: tuple[str, ...] = ("u", "v")) -> list[np.ndarray]:
        """Columns, u first, of the edges that leave the nodes, which are sorted."""
        out = [[np.empty(0, np.int64)] for _ in columns]
        for f, g, lo, hi in self.groups:
            if len(nodes) == 0 or lo is not None and np.searchsorted(nodes, lo) == np.searchsorted(nodes, hi, "right"):
                continue
            t = f.read_row_group(g, columns=list(columns), use_threads=False)
            u = t["u"].to_numpy()
            own = nodes[np.minimum(np.searchsorted(nodes, u), len(nodes) - 1)] == u
            for o, c in zip(out, columns, strict=True):
                o.append(t[c].to_numpy()[own])
        return [np.concatenate(o) for o in out]


class Ranks:
    """Rows of neighbouring ranks from files whose first column is a rank; row groups without any of them are not read."""

    def __init__(self, path: str) -> None:
        self.groups = [(f, g, s) for f in files(path) for g in range(f.metadata.num_row_groups) for s in [f.metadata.row_group(g).column(0).statistics]]

    def between(self, lo: int, hi: int, columns: tuple[str, ...]) -> pa.Table:
        """Those from rank lo to rank hi, the first column, ascending."""
        some = [(f, g) for f, g, s in self.groups if s is None or not s.has_min_max or s.min <= hi and s.max >= lo]
        some = some or [(f, g) for f, g, _ in self.groups[:1]]
        out = []
        for f, g in some:
            t = f.read_row_group(g, columns=list(columns), use_threads=False)
            r = t[columns[0]].to_numpy()
            out.append(t.filter((r >= lo) & (r <= hi)))
        t = pa.concat_tables(out)
        return t.take(np.argsort(t[columns[0]].to_numpy(), kind="stable")).combine_chunks()


#: Values of a matrix that a worker works on at once, so that they stay in its cache, and edges up to which a place takes 8 bytes.
CACHED, WIDE = 1 << 15, 1 << 22


class Reached:
    """The nodes that walks of up to `steps` edges, or of any length, from the sources reach, and the edges among them: 4 bytes
    an edge, 8 for at most WIDE edges, whose places need not be widened at each use.

    Nodes stand in descending order of degree in the reached part, so that the k-th neighbours of all nodes that have as
    many are one slice: nth(k) are their places, for the first len(nth(k)) nodes.
    """

    def __init__(self, edges: Edges, sources: np.ndarray, steps: int | None) -> None:
        known = ring = np.unique(sources)
        for _ in itertools.count() if steps is None else range(steps):
            near = np.unique(edges.of(ring)[1])
            ring = near[~np.isin(near, known, assume_unique=True)]
            if not len(ring):
                break
            known = np.union1d(known, ring)
        self.closed = not len(ring)
        u, v = edges.of(known)
        p = np.searchsorted(known, u)
        degree = np.bincount(p, minlength=len(known))
        q = np.minimum(np.searchsorted(known, v), len(known) - 1)
        inside = known[q] == v
        p, q = p[inside], q[inside]
        have = np.bincount(p, minlength=len(known))
        order = np.argsort(-have, kind="stable")
        place = np.empty(len(known), np.int64)
        place[order] = np.arange(len(known))
        by = np.argsort(place[p], kind="stable")
        first = np.concatenate(([0], np.cumsum(have[order])))
        k = np.arange(len(p)) - np.repeat(first[:-1], have[order])
        self.sorted, self.place = known, place
        self.nodes, self.degree = known[order], degree[order]
        self.columns = place[q][by][np.argsort(k, kind="stable")].astype(np.int64 if len(k) <= WIDE else np.int32)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(k)))) if len(k) else np.zeros(1, np.int64)

    def places(self, ids: np.ndarray) -> np.ndarray:
        return self.place[np.searchsorted(self.sorted, ids)]

    def chunks(self, width: int) -> list[tuple[slice, list[np.ndarray]]]:
        """Slices of nodes of which matrices of that width hold CACHED values, each with the places of first, second .. neighbours."""
        rows, starts, sizes = max(1, CACHED // max(1, width)), self.starts.tolist(), np.diff(self.starts)
        out = []
        for a in range(0, len(self.nodes), rows):
            b = min(len(self.nodes), a + rows)
            # As many nodes have a k-th neighbour as slice k is long, and fewer with each k.
            some = range(int(np.searchsorted(-sizes, -a)))
            out.append((slice(a, b), [self.columns[starts[k] + a : min(starts[k] + b, starts[k + 1])] for k in some]))
        return out


def summed(z: np.ndarray, near: list[np.ndarray], out: np.ndarray, held: np.ndarray) -> np.ndarray:
    """For each node of a slice of chunks() the sum of its neighbours' rows of z; held is scratch of at least that shape."""
    first = len(near[0]) if near else 0
    if near:
        np.take(z, near[0], axis=0, out=out[:first], mode="clip")
    out[first:] = 0
    for at in near[1:]:
        k = len(at)
        np.take(z, at, axis=0, out=held[:k], mode="clip")
        np.add(out[:k], held[:k], out=out[:k])
    return out


def blocks(spark: SparkSession, roots: DataFrame, size: int, most: int | None = None) -> DataFrame:
    """roots(id) dealt by ranges of ids, about `size` a partition, or up to `most` where every core has four partitions."""
    count = roots.count()
    if most is not None:
        size = max(size, min(most, count // (4 * spark.sparkContext.defaultParallelism)))
    return roots.select("id").repartitionByRange(max(1, -(-count // size)), "id")


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about that many at least."""
    held, count = [], 0
    for b in batches:
        held.append(b)
        count += b.num_rows
        if count >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, count = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def cuts(reached_of, ids: np.ndarray, most: int, cells: int):
    """Slices of ids, sorted, with the part of the graph that they reach: as many at once as keep nodes x sources below `cells`."""
    at, part = 0, None
    while at < len(ids):
        some = ids[at : at + most]
        if part is not None and part.closed:
            # Those up to the first that lies in another part of the graph.
            own = np.isin(some, part.sorted)
            some = some[: len(some) if own.all() else int(np.argmin(own))]
        if part is None or not part.closed or not len(some):
            some = ids[at : at + most]
            part = reached_of(some)
        some = some[: max(1, cells // max(1, len(part.nodes)))]
        yield some, part
        at += len(some)
