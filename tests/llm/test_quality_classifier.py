"""op2 against a plain version: features as words and pairs, dense vectors, one row and one coordinate at a time."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from orbweave.llm import linear, quality_classifier

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GOOD, BAD, BOTH = ["clear", "Proof", "method"], ["buy", "now", "cheap"], ["the", "of"]


def features(text):
    w = [x.lower() for x in WORD.findall(text or "")]
    pairs = list(zip(w, w[1:], strict=False))
    twice = sum(a == b for a, b in pairs)
    return {(x,) for x in w} | set(pairs) | {("twice", s, None) for s in (0, 1 / 64, 1 / 16, 1 / 4) if twice > s * len(pairs)}


def descent(x, y, cost, rounds=15, seed=7):
    """Hinge loss with an own bias column, one dual variable at a time, in the order of the seed."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, alpha, order = np.zeros(x.shape[1]), np.zeros(len(x)), np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(x)):
            slope = y[i] * (x[i] @ w) - 1
            free = slope if 0 < alpha[i] < cost[i] else min(slope, 0) if alpha[i] == 0 else max(slope, 0)
            worst = max(worst, abs(free))
            if free:
                new = min(max(alpha[i] - slope / (x[i] @ x[i]), 0), cost[i])
                w, alpha[i] = w + (new - alpha[i]) * y[i] * x[i], new
        if worst < 0.01:
            break
    return w


def curve(margin, y):
    """The logistic curve of least loss on smoothed targets, by halving steps along the gradient."""
    goal = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    loss = lambda a, b: float(np.sum(np.logaddexp(0, a * margin + b) - goal * (a * margin + b)))
    a = b = 0.0
    step = 1.0
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        da, db = float((p - goal) @ margin), float((p - goal).sum())
        while step > 1e-12 and loss(a - step * da, b - step * db) > loss(a, b) - step * (da * da + db * db) / 2:
            step /= 2
        a, b, step = a - step * da, b - step * db, step * 1.5
    return a, b


def plain_scores(rows, learn):
    """rows: texts to score; learn: (text, label) in the order of the sample."""
    names = sorted({f for t, _ in learn for f in features(t)} | {f for t in rows for f in features(t)}, key=repr)
    at = {f: i for i, f in enumerate(names)}
    size = 1 << quality_classifier.BITS
    y = np.array([1 if v else -1 for _, v in learn])
    has = np.zeros((len(learn), len(names)))
    for i, (t, _) in enumerate(learn):
        for f in features(t):
            has[i, at[f]] = 1
    good, bad = has[y > 0].sum(axis=0) + 1, has[y < 0].sum(axis=0) + 1
    # Absent buckets of the hashed table have a count of 1 as well.
    ratio = np.log(good / (good.sum() + size - len(names))) - np.log(bad / (bad.sum() + size - len(names)))
    x = np.array([r * ratio / max(math.sqrt(sum((r * ratio) ** 2)), 1e-9) for r in has])
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    w = descent(x, y, cost)
    mean = np.abs(w[:-1]).sum() / size
    weight = 0.75 * mean + 0.25 * w[:-1]
    slope, offset = curve(x @ weight + w[-1], y)
    out = []
    for t in rows:
        own = np.array([at[f] for f in features(t)], int)
        norm = max(math.sqrt(sum(ratio[own] ** 2)), 1e-9)
        out.append(1 / (1 + math.exp(-(slope * (ratio[own] @ weight[own] / norm + w[-1]) + offset))))
    return out


def corpus(seed):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(1, 121):
        good = r.random() < 0.5
        own = [r.choice((GOOD if good != (r.random() < 0.15) else BAD) + BOTH) for _ in range(r.randrange(1, 9))]
        rows.append((i, r.choice([" ", "\n", "  "]).join(own)))
        if r.random() < 0.8:
            labels.append((i, int(good)))
    # Null, empty and blank texts, labelled and not; a repeated word; a very long text.
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "now " * 40), (205, "the of " * 50_000)]
    return rows, [*labels, (200, 1), (201, 0), (203, 0), (999, 1)]


def test_scores_equal_a_plain_version(spark, tmp_path):
    for seed in (1, 2):
        rows, labels = corpus(seed)
        folder = tmp_path / str(seed)
        folder.mkdir()
        ids, texts = zip(*rows, strict=True)
        # Clashing names beyond the columns that are read.
        pq.write_table(pa.table({"doc_id": ids, "text": texts, "label": ["x"] * len(ids), "o": [0] * len(ids), "lang": [None] * len(ids)}), folder / "documents.parquet")
        pq.write_table(pa.table({"doc_id": [i for i, _ in labels], "quality": [v for _, v in labels], "toxic": [0] * len(labels)}), folder / "labels.parquet")
        kept = [(i, v) for i, v in labels if zlib.crc32(str(i).encode()) % 5 and i in ids]
        order = {r[0]: r[1] for r in spark.sql(f"SELECT id, xxhash64(id, 5) FROM VALUES {', '.join(f'({i}L)' for i, _ in kept)} AS t(id)").collect()}
        text = dict(rows)
        learn = [(text[i], v) for i, v in sorted(kept, key=lambda z: order[z[0]]) if text[i] is not None]
        assert {v for _, v in learn} == {0, 1}
        want = dict(zip(ids, plain_scores(texts, learn), strict=True))
        got = quality_classifier.op2(spark, str(folder)).collect()
        assert sorted(r["doc_id"] for r in got) == sorted(ids)
        for r in got:
            assert abs(r["score"] - want[r["doc_id"]]) < 1e-3, (seed, r, want[r["doc_id"]])
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            assert r["predicted"] == int(r["score"] >= 0.3)
        assert max(want.values()) - min(want.values()) > 0.5


def test_features_equal_words_and_pairs():
    texts = [t for _, t in corpus(3)[0]]
    got = quality_classifier.grams(pa.array(texts, pa.string()))
    assert [len(g) for g in got] == [len(features(t)) for t in texts]
    hashed = {}
    for t, g in zip(texts, got, strict=True):
        if len(features(t)) == 1:
            hashed.setdefault(next(iter(features(t))), set()).add(int(g[0]))
    assert hashed and all(len(v) == 1 for v in hashed.values())


def test_descent_reaches_the_least_loss():
    """More rounds than needed come to the optimum: no small step from it has a lower loss."""
    r = np.random.default_rng(5)
    x, y = r.normal(size=(60, 4)), np.where(r.random(60) < 0.5, 1, -1)
    cost = np.full(60, 0.5)
    w = linear.dual_descent([np.arange(4)] * 60, list(x), y, cost, 4, rounds=3000)
    loss = lambda v: v @ v / 2 + float(cost @ np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])))
    assert all(loss(w + d) >= loss(w) - 0.02 for d in r.normal(size=(500, 5)) * 0.05)
