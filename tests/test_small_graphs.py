"""Plans over the graph of a small table of order lines, against plain loops over the same edges."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from orbweave.operators.layered import kept_gaps, layered_walks
from orbweave.operators.warping import warped
from orbweave.plans import features, iterative, kernels, layered, motifs, similarity, walks
from orbweave.sources import generators


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """(folder, neighbours) of 16 parts; each order has two lines, so that it is one edge, and some orders repeat."""
    rng = random.Random(11)
    edges = [(a, b) for a in range(16) for b in range(a + 1, 16) if rng.random() < (0.7 if b < 7 else 0.2)]
    edges += edges[:3] + [(0, 15), (14, 15)]
    folder = str(tmp_path_factory.mktemp("small"))
    lines = [(i, k + 1, p) for i, e in enumerate(edges) for k, p in enumerate(e)]
    spark.createDataFrame(lines, "l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT").write.parquet(f"{folder}/lineitem.parquet")
    near = {x: set() for e in edges for x in e}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    return folder, near


def orbits(near):
    """Every connected induced subgraph of two to four nodes; an orbit is its degrees and the node's own."""
    kinds = {
        (1, 1): {1: "edge"}, (1, 1, 2): {1: "path3_end", 2: "path3_middle"}, (2, 2, 2): {2: "triangle"},
        (1, 1, 2, 2): {1: "path4_end", 2: "path4_middle"}, (1, 1, 1, 3): {1: "star_leaf", 3: "star_centre"}, (2, 2, 2, 2): {2: "cycle4"},
        (1, 2, 2, 3): {1: "paw_tail", 2: "paw_base", 3: "paw_hub"}, (2, 2, 3, 3): {2: "diamond_tip", 3: "diamond_chord"}, (3, 3, 3, 3): {3: "clique4"},
    }
    out = {x: Counter() for x in near}
    for size in (2, 3, 4):
        for nodes in itertools.combinations(sorted(near), size):
            degree = {x: len(near[x] & set(nodes)) for x in nodes}
            for x in nodes if tuple(sorted(degree.values())) in kinds else ():
                out[x][kinds[tuple(sorted(degree.values()))][degree[x]]] += 1
    return out


def test_orbits_equal_enumeration(spark, small):
    folder, near = small
    want = orbits(near)
    assert len({o for c in want.values() for o in c}) == len(motifs.ORBITS)
    got = {r["id"]: {o: r[o] for o in motifs.ORBITS} for r in motifs.QUERIES["f09_motif_orbits"](spark, folder).collect()}
    assert got == {x: {o: c[o] for o in motifs.ORBITS} for x, c in want.items()}


def test_labels_equal_quantile_cuts(spark, small):
    folder, near = small
    counts, want = orbits(near), {}
    for i, o in enumerate(motifs.ORBITS):
        x = {v: round(math.log(counts[v][o] + 1), 9) for v in near}
        if max(x.values()) > 0:
            cuts = sorted({round(float(q), 9) for q in np.quantile(list(x.values()), [0, 0.2, 0.4, 0.6, 0.8])})
            want |= {(v, i): 5 * i + max(0, sum(c < x[v] for c in cuts) - 1) for v in near}
    got = {(r["id"], r["motif"]): r["token"] for r in motifs.QUERIES["f10_motif_labels"](spark, folder).collect()}
    assert got == want
    joined = {r["id"]: r["label"] for r in motifs.QUERIES["f11_joined_labels"](spark, folder).collect()}
    assert joined == {v: "_".join(f"{t:02d}" for (x, _), t in sorted(want.items()) if x == v) for v in near}


def label_counts(near):
    out = {}
    for root in near:
        nodes = near[root] | {root}
        label = {x: "0" if x == root else "1" for x in nodes}
        seen = Counter(label.values())
        for _ in range(kernels.ROUNDS):
            label = {x: hashlib.md5((label[x] + "_" + "_".join(sorted(label[y] for y in near[x] & nodes))).encode()).hexdigest() for x in nodes}
            seen.update(label.values())
        out[root] = seen
    return out


def kernel(a, b):
    return sum(n * b[k] for k, n in a.items()) / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def test_subtree_kernel_equals_loops(spark, small):
    folder, near = small
    counts = label_counts(near)
    got = kernels.QUERIES["m18_wl_kernel"](spark, folder).collect()
    assert got and all(abs(r["kernel"] - kernel(counts[r["x"]], counts[r["y"]])) < 2e-6 for r in got)


def test_landmark_vectors_give_the_kernel(spark, small):
    """With every node a landmark and all axes, inner products are the kernel; with fewer, rows of all nodes remain."""
    folder, near = small
    counts = label_counts(near)
    got = {r["id"]: np.array(r["x"]) for r in kernels.egonet_vectors(spark, folder, m=16, dim=16).collect()}
    assert set(got) == set(near)
    assert all(abs(got[a] @ got[b] - kernel(counts[a], counts[b])) < 1e-4 for a in near for b in near)
    few = kernels.egonet_vectors(spark, folder, m=4, dim=2).collect()
    assert {r["id"] for r in few} == set(near) and all(len(r["x"]) == 2 for r in few)


def test_propagated_features(spark, small):
    folder, near = small
    rows = {r["id"]: r for r in features.QUERIES["f08_propagated"](spark, folder).collect()}
    triangles = {v: sum(b in near[a] for a, b in itertools.combinations(near[v], 2)) for v in near}
    base = {v: (len(near[v]), triangles[v], len(near[v]) + triangles[v]) for v in near}
    total = {v: [base[v][k] + sum(base[u][k] for u in near[v]) for k in range(3)] for v in near}
    for k, c in enumerate(("deg", "t", "inside")):
        for v in near:
            assert abs(rows[v][f"a_{c}"] - base[v][k] / max(b[k] for b in base.values())) < 2e-5
            assert abs(rows[v][f"s_{c}"] - total[v][k] / max(t[k] for t in total.values())) < 2e-5
            assert abs(rows[v][f"m_{c}"] - total[v][k] / len(near[v]) / max(total[u][k] / len(near[u]) for u in near)) < 2e-5


def test_second_order_walks(spark, small):
    folder, near = small

    def draw(text):
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 4294967296

    for r in walks.QUERIES["w02_second_order_walks"](spark, folder).collect():
        path = [r[f"c{k}"] for k in range(11)]
        assert path[0] == r["walk"] and path[1] in near[path[0]]
        for k in range(2, 11):
            a, b = path[k - 2], path[k - 1]
            weights = [(v, 0.25 if v == a else 1.0 if v in near[a] else 4.0) for v in sorted(near[b])]
            goal, upto = draw(f"second:{r['walk']}:{k}") * sum(w for _, w in weights), 0.0
            for v, w in weights:
                upto += w
                if upto >= goal:
                    break
            assert path[k] == v


def layers(near):
    """Degrees with their counts at distances 0, 1 and 2 from every node."""
    out = {}
    for x in near:
        two = {z for y in near[x] for z in near[y]} - near[x] - {x}
        out[x] = [sorted(Counter(len(near[z]) for z in ring).items()) for ring in ({x}, near[x], two) if ring]
    return out


def test_layered_graph_and_walks(spark, small):
    folder, near = small
    rings = layers(near)
    far = {(r["x"], r["y"], r["d"]): r["f"] for r in layered.QUERIES["m13_cumulative_distance"](spark, folder).collect()}
    assert len(far) > 3 * len(near)
    for (x, y, d), f in far.items():
        want = 0.0
        for k in range(d + 1):
            a, b = (np.array(rings[v][k], float) for v in (x, y))
            want += warped([a[:, 0]], [b[:, 0]], [a[:, 1]], [b[:, 1]])[0]
        assert abs(f - want) < 2e-6
    assert {(x, y) for x, y, _ in far} == {(x, y) for x, y, d in far if d == 0}
    gaps = {(r["x"], r["y"], r["d"]): r["c"] for r in layered.QUERIES["m11_layer_distances"](spark, folder).collect()}
    assert all(abs(far[x, y, d] - sum(gaps[x, y, k] for k in range(d + 1))) < 1e-5 for x, y, d in far)
    w = {}
    for (x, y, d), f in far.items():
        w.setdefault((x, d), {})[y] = w.setdefault((y, d), {})[x] = math.exp(-f)
    for r in layered.QUERIES["m14_layer_weights"](spark, folder).collect():
        assert abs(r["p"] - w[r["u"], r["d"]][r["v"]] / sum(w[r["u"], r["d"]].values())) < 1e-5
    mean = {d: np.mean([x for (_, k), z in w.items() if k == d for x in z.values()]) for d in range(3)}
    gamma = {(r["u"], r["d"]): r["gamma"] for r in layered.QUERIES["m15_layer_gamma"](spark, folder).collect()}
    assert gamma == {(u, d): sum(x > mean[d] for x in z.values()) for (u, d), z in w.items()}

    def draw(*parts):
        return int(hashlib.md5(":".join(map(str, ("layer", *parts))).encode()).hexdigest()[:8], 16) / 4294967296

    paths = layered.QUERIES["w05_layered_walks"](spark, folder).collect()
    assert len(paths) == len(near)
    for r in paths:
        now, layer, climbed = r["walk"], 0, 0
        assert r["path"][0] == now and len(r["path"]) == 11
        for k in range(1, 11):
            for i in range(1, math.floor(math.log(draw(now0 := r["walk"], r["turn"], k)) / math.log(0.7)) + 1):
                x = math.log(gamma[now, layer] + math.e)
                if draw(now0, r["turn"], k, i) <= x / (x + 1):
                    layer += (now, layer + 1) in w
                else:
                    layer = max(0, layer - 1)
                climbed = max(climbed, layer)
            goal, upto = draw(now0, r["turn"], k, "to") * sum(w[now, layer].values()), 0.0
            for v, x in sorted(w[now, layer].items()):
                upto += x
                if upto > goal:
                    break
            assert r["path"][k] == v
            now = v


def test_layered_walks_cross_groups_without_being_moved(spark):
    """Groups of a few cells of ranks, however pairs were grouped, give the walks of a single group; no step joins or moves walks."""
    folder = "/root/testdata/sf0.01"
    ranked, rings = similarity.candidates(spark, folder), layered.sequences(spark, folder)
    some, whole = (layered_walks(spark, kept_gaps(spark, ranked, rings, cells=n), cells=c) for n, c in ((7, 16), (32, 1000)))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    some, whole = ({r["walk"]: r["path"] for r in x.collect()} for x in (some, whole))
    assert some == whole and len(some) == 2000


def test_closeness_and_betweenness_equal_all_paths(spark, small):
    """Distances by breadth, and every shortest path written out."""
    folder, near = small
    through, want = Counter(), {}
    for root in near:
        paths = {root: [(root,)]}
        ring = [root]
        while ring:
            found = {}
            for x in ring:
                for y in near[x] - set(paths):
                    found.setdefault(y, []).extend((*p, y) for p in paths[x])
            paths |= found
            ring = list(found)
        for end, ps in paths.items():
            for p in ps if end != root else ():
                through.update({x: 1 / len(ps) for x in p[1:-1]})
        far = [len(ps[0]) - 1 for ps in paths.values()]
        want[root] = (len(paths) - 1, max(far), (len(paths) - 1) ** 2 / sum(far) / (len(near) - 1))
    got = {r["id"]: r for r in iterative.closeness_of(spark, folder, every=1).collect()}
    assert set(got) == set(near) and all((got[x]["reached"], got[x]["far"]) == want[x][:2] and abs(got[x]["closeness"] - want[x][2]) < 2e-6 for x in near)
    b = {r["id"]: r["betweenness"] for r in iterative.betweenness_of(spark, folder, every=1).collect()}
    assert set(b) == set(near) and all(abs(b[x] - through[x]) < 2e-5 for x in near)


def test_random_regular_is_regular(spark):
    edges = [(r["src"], r["dst"]) for r in generators.QUERIES["g01_random_regular"](spark, "").collect()]
    degree = Counter(x for e in edges for x in e)
    assert len(edges) == len(set(edges)) == 1500 and set(degree.values()) == {3} and len(degree) == 1000


def test_pyramid_match_equals_loops(spark, small):
    """Pairs are met by the last join: neither they nor bins of theirs are moved or summed."""
    folder, near = small
    bags = {v: {w: Counter(len(near[x]) // w for x in near[v]) for w in (1, 8)} for v in near}
    want = {(r["x"], r["y"]): tuple((bags[r["x"]][w] & bags[r["y"]][w]).total() for w in (8, 1)) for r in similarity.QUERIES["m12_degree_candidates"](spark, folder).collect()}
    df = similarity.QUERIES["f27_pyramid_match"](spark, folder)
    assert {(r["x"], r["y"]): (r["coarse"], r["fine"]) for r in df.collect()} == {k: v for k, v in want.items() if v[0]}
    assert df._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0].count("Aggregate") == 0
