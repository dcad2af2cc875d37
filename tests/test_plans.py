"""Every registered plan against its oracle on the smallest tables."""

import math
import random
from pathlib import Path

import duckdb
import pytest

from orbweave.plans import diffusion, embedding, evaluation, features, iterative, kernels, layered, motifs, relational, similarity, sources, streams, walks, wavelets
from orbweave.sources import generators

SF = "/root/testdata/sf0.001"
MODULES = (relational, features, motifs, similarity, kernels, diffusion, wavelets, walks, embedding, evaluation, sources, streams, generators, iterative)
PLANS = {n: (q, m.ORACLES[n]) for m in MODULES for n, q in m.QUERIES.items() if n in m.ORACLES}


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(None if v[i] is None or v[i] != v[i] else round(float(v[i]), 4) if isinstance(v[i], float) else v[i] for i in order) for v in values), key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", PLANS)
def test_plan_equals_oracle(spark, duck, name):
    run, sql = PLANS[name]
    got = run(spark, SF)
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    a, b = rows(got.columns, got.collect()), rows(names, want.fetchall())
    assert sorted(got.columns) == sorted(names) and len(a) == len(b)
    assert all(x == y or all(p == q or (isinstance(p, float) and math.isclose(p, q, abs_tol=2e-4)) for p, q in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True))


def test_learners(spark):
    """Properties of results that have no SQL: they cover every row, and beat chance on labelled vectors."""
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    classes = vectors.select("label").distinct().count()
    for name in ("v01_one_versus_rest", "v13_multinomial"):
        score = embedding.QUERIES[name](spark, SF).head()
        assert 0 < score.n < vectors.count() and 1 / (2 * classes) <= score.f1_micro <= 1 and 0 <= score.f1_macro <= 1
    assert embedding.QUERIES["v02_kmeans"](spark, SF).count() == embedding.QUERIES["v06_projection"](spark, SF).count() == vectors.count()
    nodes = features.QUERIES["f01_degree"](spark, SF).count()
    roles = embedding.QUERIES["e01_role_factors"](spark, SF)
    assert roles.count() == nodes and roles.where("least(role_0, role_1, role_2, role_3) < 0").isEmpty()
    assert layered.QUERIES["e05_walk_vectors"](spark, SF).count() == embedding.QUERIES["e07_role_vectors"](spark, SF).count() == nodes
    roles = embedding.QUERIES["e02_nmf_roles"](spark, SF)
    assert roles.count() == nodes and roles.where("least(role_0, role_1, role_2, role_3) < 0").isEmpty()
    labels = embedding.QUERIES["f11_clustered_labels"](spark, SF)
    assert labels.count() == nodes and 1 < labels.select("label").distinct().count() <= 50
    assert 0 <= embedding.QUERIES["v02_cluster_agreement"](spark, SF).head().nmi <= 1
    scores = embedding.repeated_scores(spark, SF).collect()
    assert sorted(r["ratio"] for r in scores) == [k / 10 for k in range(1, 10)] and all(0 <= r["f1_macro"] <= 1 and 0 <= r["f1_micro"] <= 1 for r in scores)
    links = {r["features"]: r for r in embedding.QUERIES["v03_link_prediction"](spark, SF).collect()}
    dots = embedding.QUERIES["v12_dot_scores"](spark, SF).head()
    assert 0 <= dots.auc <= 1 and 0 <= dots.recall <= 1
    assert set(links) == {"hadamard", "average"} and all(0 <= r["auc"] <= 1 and 0 <= r["average_precision"] <= 1 for r in links.values())


def test_ranking_scores(spark):
    rng = random.Random(3)
    rows = [(float(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(300)] + [(1.0, 1.0), (0.0, 0.0)]
    got = embedding.ranking_scores(spark.createDataFrame(rows, "label DOUBLE, p DOUBLE")).head()
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    precision = sum(sum(a >= p for a in pos) / sum(q >= p for _, q in rows) for p in pos) / len(pos)
    hits = sum(p > 0.5 for p in pos)
    assert abs(got.auc - auc) < 2e-6 and abs(got.average_precision - precision) < 2e-6
    assert abs(got.recall - hits / len(pos)) < 2e-6
    assert abs(got.f1 - 2 * hits / (sum(p > 0.5 for _, p in rows) + len(pos))) < 2e-6
