"""Blocks of sources over the parts of a graph: sums in slices, cuts at the ends of parts, power sums, rounding in workers."""

import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbweave.operators import cores, heat, paths, refex
from orbweave.operators.graph_blocks import Reached, blocks, cuts, gathered
from orbweave.plans.wavelets import _entries_of, turned


class Held:
    """Edges of given nodes from memory."""

    def __init__(self, pairs):
        e = sorted({(a, b) for x, y in pairs for a, b in ((x, y), (y, x)) if a != b})
        self.u, self.v = (np.array([p[i] for p in e], np.int64) for i in (0, 1))

    def of(self, nodes, columns=("u", "v")):
        own = np.isin(self.u, nodes)
        return [self.u[own], self.v[own]]


def hub_graph(n=1500, seed=3):
    """A hub with an edge to every second node, a cycle, and random edges: slices of 1,024 nodes have unlike degrees."""
    r = random.Random(seed)
    return [(0, i) for i in range(2, n, 2)] + [(i, (i + 1) % n) for i in range(n)] + [(r.randrange(n), r.randrange(n)) for _ in range(n)]


def test_columns_equal_dense_recurrence_over_slices():
    edges = Held(hub_graph())
    ids = np.arange(0, 1500, 50)
    part = Reached(edges, ids, heat.ORDER)
    assert len(part.chunks(len(ids))) > 1
    c = [heat.chebyshev(t) for t in (0.5, 30.0)]
    n = len(part.nodes)
    a = np.zeros((n, n))
    a[part.places(edges.u), part.places(edges.v)] = 1.0
    w = -a / np.sqrt(np.outer(part.degree, part.degree))
    prev, cur = np.eye(n)[:, part.places(ids)], w[:, part.places(ids)]
    want = [x[0] * prev + x[1] * cur for x in c]
    for k in range(2, heat.ORDER + 1):
        prev, cur = cur, 2 * w @ cur - prev
        want = [y + x[k] * cur for x, y in zip(c, want, strict=True)]
    for got, y in zip(heat._columns(part, ids, c), want, strict=True):
        assert got.shape == (len(ids), n)
        assert np.abs(got - y.T).max() < 1e-13


def test_no_step_for_the_last_coefficient(monkeypatch):
    calls = []
    summed = heat.summed
    monkeypatch.setattr(heat, "summed", lambda *a: calls.append(1) or summed(*a))
    heat._columns(Reached(Held([(1, 2), (2, 3)]), np.array([1]), 30), np.array([1]), [heat.chebyshev(2.0)])
    assert len(calls) == heat.ORDER - 1


def test_cuts_stop_where_a_part_ends():
    """Two parts of 100 nodes: no block holds both but the first may, and each part is read once."""
    edges = Held([(i, i + 1) for i in range(199) if i != 99] + [(0, 99), (100, 199)])
    read = []
    got = list(cuts(lambda x: read.append(x) or Reached(edges, x, None), np.arange(200), 32, 1 << 22))
    assert np.array_equal(np.concatenate([some for some, _ in got]), np.arange(200))
    assert len(read) == 2
    assert all(len(part.nodes) == 100 for _, part in got)


def test_many_roots_are_dealt_in_larger_blocks(spark):
    roots = spark.range(4000)
    cores = spark.sparkContext.defaultParallelism
    assert blocks(spark, roots, 64, 512).rdd.getNumPartitions() == -(-4000 // max(64, min(512, 4000 // (4 * cores))))
    assert blocks(spark, roots, 64).rdd.getNumPartitions() == 63


def test_shortest_paths_take_no_idle_products(monkeypatch):
    """In a complete graph all nodes are met at once, and no path passes a node between two others."""
    calls = []
    summed = paths.summed
    monkeypatch.setattr(paths, "summed", lambda *a: calls.append(1) or summed(*a))
    part = Reached(Held([(i, j) for i in range(6) for j in range(i)]), np.array([0, 3]), None)
    assert not paths._passed(part, np.array([0, 3])).any()
    assert len(calls) == 1


def test_passed_equals_brandes_over_slices():
    edges = Held(hub_graph(1300, 5) + [(2000, 2001)])
    roots = np.array([0, 7, 650, 2000] + list(range(900, 1300, 14)))
    part = Reached(edges, roots, None)
    assert len(part.chunks(len(roots))) > 1
    near = {}
    for u, v in zip(edges.u.tolist(), edges.v.tolist(), strict=True):
        near.setdefault(u, []).append(v)
    want = dict.fromkeys(part.nodes.tolist(), 0.0)
    for s in roots.tolist():
        depth, count, order = {s: 0}, {s: 1.0}, [s]
        for u in order:
            for v in near[u]:
                if v not in depth:
                    depth[v], count[v] = depth[u] + 1, 0.0
                    order.append(v)
                if depth[v] == depth[u] + 1:
                    count[v] += count[u]
        share = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in near[v]:
                if depth[u] == depth[v] - 1:
                    share[u] += count[u] / count[v] * (1 + share[v])
            want[v] += share[v] if v != s else 0.0
    assert paths._passed(part, roots) == pytest.approx([want[i] for i in part.nodes.tolist()], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("top", [1e-4, 4e-3, 0.02, 0.9])
def test_power_sums_equal_direct_sums(top):
    x = np.random.default_rng(1).random(3000) * top
    for times in (np.arange(25) * (100 / 24), np.ones(1), np.zeros(2)):
        assert np.abs(turned(x, times) - np.exp(1j * np.outer(times, x)).sum(1)).max() < 1e-9
    assert np.array_equal(turned(np.empty(0), np.ones(2)), np.zeros(2))


def test_entries_are_rounded_half_up():
    x = np.concatenate([np.random.default_rng(2).random(2000) * 10.0 ** -np.arange(8).repeat(250), [0.25, 1.5e-7, 1e-12]])
    got = _entries_of(10, 5, 1, np.arange(len(x)), x)
    assert got.schema.names == ["j", "i", "s", "x"]
    assert got["x"].to_pylist() == [float(Decimal(repr(v + 1e-10)).quantize(Decimal("1e-7"), ROUND_HALF_UP)) for v in x.tolist()]


def test_small_batches_are_gathered():
    batches = [pa.RecordBatch.from_pydict({"a": np.arange(i, i + 3)}) for i in range(0, 30, 3)]
    got = list(gathered(iter(batches), 10))
    assert [b.num_rows for b in got] == [12, 12, 6]
    assert [v for b in got for v in b["a"].to_pylist()] == list(range(30))


def test_blocks_of_nodes_settle_core_numbers(spark, monkeypatch):
    """Blocks of about 100 edges, whose edges lead to other blocks, against peeling; a block that holds all settles at once."""
    edges = Held(hub_graph(300, 9) + [(400 + i, 400 + j) for i in range(7) for j in range(i)] + [(500 + i, 501 + i) for i in range(40)])
    near = {}
    for u, v in zip(edges.u.tolist(), edges.v.tolist(), strict=True):
        near.setdefault(u, set()).add(v)
    left, want, k = {u: set(x) for u, x in near.items()}, {}, 0
    while left:
        u = min(left, key=lambda i: len(left[i]))
        k = max(k, len(left[u]))
        want[u] = k
        for v in left.pop(u):
            if v in left:
                left[v].discard(u)
    monkeypatch.setattr(cores, "EDGES", 100)
    adj = spark.createDataFrame(list(zip(edges.u.tolist(), edges.v.tolist(), strict=True)), "u BIGINT, v BIGINT")
    assert {r["id"]: r["core"] for r in cores.core_numbers(spark, adj).collect()} == want
    ids, u = np.unique(edges.u, return_inverse=True)
    to = np.searchsorted(ids, edges.v)
    now = np.bincount(u)
    assert cores.lowered(now, u, now[to], np.arange(len(to)), to).tolist() == [want[i] for i in ids.tolist()]


def test_split_millionths_add_up_to_exact_sums(spark):
    """What edges add in two 64-bit numbers equals the sum in decimals, for either sign, nulls and beyond 64 bits."""
    rows = [(k % 7, float(x)) for k, x in enumerate(np.random.default_rng(4).normal(size=200) * 10.0 ** (np.arange(200) % 13))] + [(9, 9e12), (9, 8e12), (9, 0.0000005), (8, None), (6, None)]
    df = spark.createDataFrame(rows, "k INT, x DOUBLE")
    cells = df.select("k", "x", *refex._split("x"))
    for f, of in refex.TOTALS.items():
        got = cells.groupBy("k").agg(of(refex._total("x"), F.count("x__hi")).alias("a"), f(F.col("x")).alias("b")).collect()
        assert len(got) == 9 and all(r["a"] == r["b"] for r in got)
