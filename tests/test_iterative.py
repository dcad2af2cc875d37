"""Iterative operators against brute force."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from orbweave.operators.cores import core_numbers
from orbweave.operators.factors import nonnegative_factors, start
from orbweave.operators.graph_blocks import placed
from orbweave.operators.heat import chebyshev, heat_columns
from orbweave.operators.layered import rings
from orbweave.operators.matching import best_matching, matched_similarity
from orbweave.operators.nearest import nearest_of_other_folds
from orbweave.operators.paths import betweenness
from orbweave.operators.profiles import profile_distances
from orbweave.operators.refex import exact_mean, exact_sum
from orbweave.operators.regression import explained, independent, nonnegative_least_squares, regressive_features
from orbweave.operators.warping import warped, warped_pairs

#: A graph of ten nodes with known similarities after any round.
TEN = [(0, 4), (1, 5), (2, 6), (3, 7), (4, 5), (4, 8), (5, 8), (6, 7), (6, 9), (7, 9), (8, 9)]


def adjacency(spark, edges):
    return spark.createDataFrame([(a, b) for a, b in edges] + [(b, a) for a, b in edges], "u BIGINT, v BIGINT")


def test_matching_equals_all_permutations():
    rng = np.random.default_rng(3)
    for rows, cols in [(1, 1), (2, 4), (4, 2), (5, 5), (3, 6)] * 5:
        w = np.round(rng.random((rows, cols)), 2)
        short = w if rows <= cols else w.T
        want = max(sum(short[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(short.shape[1]), short.shape[0]))
        assert abs(best_matching(w) - want) < 1e-9


def test_role_similarity_known(spark):
    s = {(r.x, r.y): r.s for r in matched_similarity(spark, adjacency(spark, TEN), 2).collect()}
    assert abs(s[0, 1] - 1) < 1e-9 and abs(s[0, 4] - 0.4) < 1e-9 and len(s) == 45


def test_warping_equals_recursion():
    def slow(p, q, fp, fq, i, j):
        c = ((max(p[i], q[j]) + 0.5) / (min(p[i], q[j]) + 0.5) - 1) * max(fp[i], fq[j])
        if i == 0 and j == 0:
            return c
        return c + min(slow(p, q, fp, fq, a, b) for a, b in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if a >= 0 and b >= 0)

    rng = np.random.default_rng(5)
    sizes = [(1, 1), (1, 4), (4, 1), (5, 6), (6, 3)] * 4
    p, q = ([np.sort(rng.integers(1, 40, x[k])).astype(float) for x in sizes] for k in (0, 1))
    fp, fq = ([rng.integers(1, 5, x[k]).astype(float) for x in sizes] for k in (0, 1))
    got = warped(p, q, fp, fq)
    assert all(abs(got[i] - slow(p[i], q[i], fp[i], fq[i], n - 1, m - 1)) < 1e-9 for i, (n, m) in enumerate(sizes))
    none = np.empty(0)
    assert warped([none, none, p[0]], [none, q[0], none]).tolist() == [0.0, math.inf, math.inf]


def test_cores_equal_peeling(spark):
    rng = random.Random(7)
    edges = sorted({(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < (0.4 if b < 15 else 0.06)})
    left, want, k = {x: {b for a, b in edges if a == x} | {a for a, b in edges if b == x} for x in {x for e in edges for x in e}}, {}, 0
    while left:
        low = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[low]))
        want[low] = k
        for y in left.pop(low):
            left[y].discard(low)
    got = {r.id: r.core for r in core_numbers(spark, adjacency(spark, edges)).select("id", F.col("core")).collect()}
    assert got == want


def test_factors_equal_plain_updates(spark):
    """The replayed weights are those of the usual alternation, and a product of rank 2 is found again."""
    rng = np.random.default_rng(1)
    f = rng.random((30, 2)) @ rng.random((2, 5))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(f)], "id BIGINT, f ARRAY<DOUBLE>").repartition(3)
    got, h = nonnegative_factors(spark, rows, 5, rank=2, iterations=12)
    w = np.array([r["w"] for r in got.orderBy("id").collect()])
    w2, h2 = start(np.arange(30), 2), np.random.default_rng(7).random((2, 5)) + 0.1
    for _ in range(12):
        w2 = w2 * (f @ h2.T) / (w2 @ h2 @ h2.T + 1e-12)
        h2 = h2 * (w2.T @ f) / (w2.T @ w2 @ h2 + 1e-12)
    w2 = w2 * (f @ h2.T) / (w2 @ h2 @ h2.T + 1e-12)
    assert np.allclose(w, w2, atol=1e-8) and np.allclose(h, h2, atol=1e-8) and (w >= 0).all()
    assert np.abs(w @ h - f).mean() < 0.05


def test_independent_columns_equal_residuals():
    rng = np.random.default_rng(4)
    x = rng.random((50, 4))
    x = np.column_stack((x[:, 0], 2 * x[:, 0], x[:, 1], x[:, 0] - 3 * x[:, 1], np.zeros(50), x[:, 2], x[:, 2] + 1e-3 * x[:, 3]))
    want = []
    for j in range(x.shape[1]):
        left = x[:, j] - (x[:, want] @ np.linalg.lstsq(x[:, want], x[:, j], rcond=None)[0] if want else 0)
        if np.linalg.norm(left) > 1e-5 * np.linalg.norm(x[:, j]) > 0:
            want.append(j)
    assert independent(x.T @ x) == want == [0, 2, 5, 6]


def test_regressive_features_equal_loops(spark):
    """On the graph of ten nodes, from degrees and a second column: the same columns and values as by plain residuals."""
    near = {x: sorted({b for a, b in TEN if a == x} | {a for a, b in TEN if b == x}) for x in range(10)}
    columns = {"a": [float(len(near[x])) for x in range(10)], "b": [float(x % 4) for x in range(10)]}

    def spanned(kept, y):
        left = y - (m := np.array([columns[c] for c in kept]).T) @ np.linalg.lstsq(m, y, rcond=None)[0] if kept else y
        return np.linalg.norm(left) <= 1e-5 * np.linalg.norm(y)

    kept, new = ["a", "b"], ["a", "b"]
    for _ in range(2):
        found = []
        for c in new:
            for name, f in (("_s", sum), ("_m", lambda z: sum(z) / len(z))):
                columns[c + name] = [float(f([columns[c][y] for y in near[x]])) for x in range(10)]
                if not spanned(kept + found, np.array(columns[c + name])):
                    found.append(c + name)
        kept, new = kept + found, found
    base = spark.createDataFrame([(x, columns["a"][x], columns["b"][x]) for x in range(10)], "id BIGINT, a DOUBLE, b DOUBLE")
    rows, names = regressive_features(spark, adjacency(spark, TEN), base, 2)
    assert names == kept and len(kept) > 4
    for r in rows.collect():
        assert all(abs(r[c] - columns[c][r["id"]]) < 1e-9 for c in names)


def test_nonnegative_weights_equal_best_subset(spark):
    rng = np.random.default_rng(9)
    for _ in range(10):
        x, y = rng.random((20, 3)), rng.standard_normal(20)
        best, least = np.zeros(3), y @ y
        for k in (1, 2, 3):
            for some in itertools.combinations(range(3), k):
                w = np.linalg.lstsq(x[:, some], y, rcond=None)[0]
                error = ((y - x[:, some] @ w) ** 2).sum()
                if (w >= 0).all() and error < least:
                    least, best = error, np.zeros(3)
                    best[list(some)] = w
        assert np.allclose(nonnegative_least_squares(x.T @ x, x.T @ y), best, atol=1e-6)
    rows = spark.createDataFrame([(float(a), float(b), 2.0 * a + 3.0 * b) for a, b in [(1, 0), (0, 1), (1, 1), (2, 1)]], "p DOUBLE, q DOUBLE, m DOUBLE")
    got = {r["role"]: r for r in explained(spark, rows, ["p", "q"], ["m"]).collect()}
    assert abs(got["p"]["weight"] - 2) < 1e-6 and abs(got["q"]["weight"] - 3) < 1e-6 and abs(got["p"]["relative"] - 2 / 4.25) < 1e-6


def test_halves_round_up_in_any_order(spark):
    """Means and sums of values of six decimals are rounded as fractions are, whatever the order in which rows come."""
    rng = random.Random(5)
    rows, want = [], {}
    for k, n in enumerate((2, 4, 8, 16, 20, 32, 40, 50, 64, 80) * 20):
        units = [rng.randrange(1, 90000) for _ in range(n)]
        units[0] += (n // 2 - sum(units)) % n
        want[k] = (sum(units) / 1e6, (2 * sum(units) + n) // (2 * n) / 1e6)
        rows += [(k, u / 1e6) for u in units]
    for _ in range(2):
        rng.shuffle(rows)
        got = spark.createDataFrame(rows, "k INT, x DOUBLE").groupBy("k").agg(*[F.round(f(F.col("x")), 6).alias(n) for n, f in (("s", exact_sum), ("m", exact_mean))])
        assert {r.k: (r.s, r.m) for r in got.collect()} == want
    got = spark.createDataFrame([(-0.000001,), (-0.000002,), (None,)], "x DOUBLE").agg(exact_sum(F.col("x")).alias("s"), exact_mean(F.col("x")).alias("m")).head()
    assert (got.s, got.m) == (-0.000003, -0.000002)


def test_heat_columns_equal_dense_polynomials(spark):
    """More sources than a worker multiplies at once, over a graph in two parts, one of them a long string; nothing is shuffled but the graph and the sources."""
    rng = random.Random(2)
    edges = sorted({(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.15} | {(k, k + 1) for k in range(39)}) + [(k, k + 1) for k in range(100, 145)]
    ids = sorted({x for e in edges for x in e})
    a = np.zeros((len(ids), len(ids)))
    for x, y in edges:
        a[ids.index(x), ids.index(y)] = a[ids.index(y), ids.index(x)] = 1
    p = a / np.sqrt(np.outer(a.sum(1), a.sum(1)))
    t = [np.eye(len(ids)), -p]
    while len(t) < 31:
        t.append(-2 * p @ t[-1] - t[-2])
    want = [sum(c * m for c, m in zip(chebyshev(tau), t)) for tau in (0.5, 3.0)]

    def finish(j, s, i, x):
        yield pa.RecordBatch.from_pydict({"j": [j] * len(i), "s": [s] * len(i), "i": i, "x": x})

    out = heat_columns(spark, placed(spark, adjacency(spark, edges)), spark.createDataFrame([(x,) for x in ids], "id BIGINT"), [0.5, 3.0], finish, "j BIGINT, s BIGINT, i BIGINT, x DOUBLE")
    assert "Join" not in out._jdf.queryExecution().toString()
    got = [np.zeros(a.shape) for _ in want]
    for r in out.collect():
        got[r.s][ids.index(r.i), ids.index(r.j)] = r.x
    assert all(np.abs(g - w).max() < 1e-12 for g, w in zip(got, want))


def test_nearest_of_other_folds_equal_sorting(spark):
    """Copies, null vectors and more queries than a block; what is found holds the first three of every turn, and few more."""
    rng = random.Random(4)
    x = [[round(rng.random(), 3) for _ in range(3)] for _ in range(700)]
    x[100:400] = [x[0]] * 300
    x[5] = x[600] = None
    folds = [[rng.randrange(10), rng.randrange(2)] for _ in x]
    df = spark.createDataFrame(list(zip(range(700), x, folds)), "id BIGINT, x ARRAY<FLOAT>, folds ARRAY<INT>")
    found = {}
    for r in nearest_of_other_folds(spark, df, df.select("id"), 3).collect():
        found.setdefault(r.q, []).append((r.d, r.b))
    assert set(found) == set(range(700)) and max(map(len, found.values())) < 60
    f = [None if v is None else np.array(v, np.float32).astype(float) for v in x]
    for q in range(0, 700, 7):
        far = sorted((math.inf if f[q] is None or f[b] is None else round(float(((f[q] - f[b]) ** 2).sum()), 5), b) for b in range(700) if b != q)
        for t in range(2):
            want = [b for _, b in far if folds[b][t] != folds[q][t]][:3]
            assert [b for _, b in sorted((round(d, 5), b) for d, b in found[q]) if folds[b][t] != folds[q][t]][:3] == want


def test_warped_pairs_equal_one_by_one():
    """Padded rows of unequal lengths, in more pairs than are taken at once."""
    rng = np.random.default_rng(8)
    rows = [np.unique(rng.integers(1, 60, rng.integers(1, 30))) for _ in range(40)]
    counts = [rng.integers(1, 9, len(r)) for r in rows]
    g, f = (np.array([[*r, *[1] * (40 - len(r))] for r in x], float) for x in (rows, counts))
    i, j = np.divmod(np.arange(1600), 40)
    got = warped_pairs(g, f, np.array([len(r) for r in rows]), i, j, together=64)
    want = [warped([rows[a].astype(float)], [rows[b].astype(float)], [counts[a].astype(float)], [counts[b].astype(float)])[0] for a, b in zip(i, j)]
    assert np.allclose(got, want, rtol=1e-12, atol=1e-12)


def test_betweenness_of_strings_and_stars(spark):
    """More roots than a block, long distances and several parts: known values, and no join over roots and nodes."""
    edges = [(k, k + 1) for k in range(59)] + [(100, 101 + k) for k in range(50)] + [(200, 201), (201, 203), (200, 202), (202, 203)]
    adj = adjacency(spark, edges)
    out = betweenness(spark, placed(spark, adj), adj, adj.select(F.col("u").alias("id")).distinct())
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {k: 2.0 * k * (59 - k) for k in range(60)} | {100: 50.0 * 49} | {101 + k: 0.0 for k in range(50)} | {200 + k: 1.0 for k in range(4)}
    assert {r.id: round(r.betweenness, 9) for r in out.collect()} == want


def test_rings_of_small_blocks(spark):
    """Blocks whose nodes and neighbours are not in sight of each other: strings, a star, a cycle and random edges."""
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(20)] + [(30, 31 + k) for k in range(6)] + [(40 + k, 40 + (k + 1) % 5) for k in range(5)]
    edges += sorted({(a, b) for a in range(50, 80) for b in range(a + 1, 80) if rng.random() < 0.08})
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    adj = spark.createDataFrame([(u, v, len(near[v])) for u in near for v in near[u]], "u BIGINT, v BIGINT, w BIGINT")
    for r in rings(spark, placed(spark, adj), adj.select(F.col("u").alias("id")).distinct(), together=3, at_once=2).collect():
        two = {z for y in near[r.id] for z in near[y]} - near[r.id] - {r.id}
        for k, ring in enumerate(({r.id}, near[r.id], two)):
            degrees = sorted(len(near[x]) for x in ring)
            assert r[f"g{k}"] == sorted(set(degrees)) and r[f"f{k}"] == [degrees.count(x) for x in sorted(set(degrees))]


def test_profile_distances_equal_dense_heat(spark):
    """Groups of one cell, over parts that do not see each other, against dense matrices; only nodes are moved."""
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(12)] + [(30, 31 + k) for k in range(5)] + sorted({(a, b) for a in range(50, 70) for b in range(a + 1, 70) if rng.random() < 0.15})
    ids = sorted({x for e in edges for x in e})
    a = np.zeros((len(ids), len(ids)))
    for x, y in edges:
        a[ids.index(x), ids.index(y)] = a[ids.index(y), ids.index(x)] = 1
    deg = a.sum(1)
    p = a / np.sqrt(np.outer(deg, deg))
    heat, two = 0.625 * np.eye(len(ids)) + 0.25 * p + 0.125 * p @ p, np.eye(len(ids)) + a + a @ a > 0
    want = {x: sorted(heat[i][two[i]], reverse=True) for i, x in enumerate(ids)}
    adj = spark.createDataFrame([(u, v, int(deg[ids.index(v)])) for e in edges for u, v in (e, e[::-1])], "u BIGINT, v BIGINT, w BIGINT")
    line = rng.sample(ids, len(ids))
    got = profile_distances(spark, placed(spark, adj), spark.createDataFrame([(x, r, 4, r // 4) for r, x in enumerate(line, 1)], "id BIGINT, r BIGINT, k BIGINT, c BIGINT"), cells=1).collect()
    assert {(r.x, r.y) for r in got} == {(x, y) for i, x in enumerate(line) for y in line[i + 1 : i + 5]}
    for r in got:
        d = [abs(s - t) for s, t in zip(want[r.x], want[r.y])]
        assert abs(r.ks - max(d)) < 1e-9 and abs(r.area - sum(d)) < 1e-8
