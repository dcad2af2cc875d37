"""Maximum-weight matching of neighbourhoods, and the node similarities defined by it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.shared import ship, written


def best_matching(w: np.ndarray) -> float:
    """Weight of the best matching of rows to columns of a matrix of weights >= 0, by shortest augmenting paths."""
    w = w if w.shape[0] <= w.shape[1] else w.T
    rows, cols = w.shape
    cost = w.max(initial=0.0) - w
    u, v, owner = np.zeros(rows), np.zeros(cols), np.full(cols, -1)
    for r in range(rows):
        dist, prev, done = cost[r] - u[r] - v, np.full(cols, -1), np.zeros(cols, bool)
        while True:
            j = int(np.where(done, np.inf, dist).argmin())
            done[j] = True
            if owner[j] < 0:
                break
            via = dist[j] + cost[owner[j]] - u[owner[j]] - v
            better = ~done & (via < dist)
            dist[better], prev[better] = via[better], j
        reach = dist[j]
        for k in np.flatnonzero(done):
            if k != j:
                u[owner[k]] += reach - dist[k]
                v[k] -= reach - dist[k]
        u[r] += reach
        while prev[j] >= 0:
            owner[j], j = owner[prev[j]], prev[j]
        owner[j] = r
    return float(sum(w[owner[j], j] for j in range(cols) if owner[j] >= 0))


def _weights(pdf: pd.DataFrame) -> pd.DataFrame:
    m = np.zeros((pdf.a.nunique(), pdf.b.nunique()))
    m[pdf.a.astype("category").cat.codes, pdf.b.astype("category").cat.codes] = pdf.s
    return pd.DataFrame({"x": [pdf.x.iloc[0]], "y": [pdf.y.iloc[0]], "w": [best_matching(m)]})


def matched_similarity(spark: SparkSession, adj: DataFrame, rounds: int, beta: float = 0.9, start: str = "ratio", theta: float = 0.0, alpha: float = 0.5) -> DataFrame:
    """(x, y, s) for x < y: s = beta * best matching of the neighbours / larger degree + 1 - beta, a node's own s is 1.

    start is "ratio" (of degrees), "binary" (equal degrees) or "identity" (0; with beta = 1 neighbours then match by identity).
    Pairs whose ratio of degrees is below theta are not kept and count as alpha times that ratio (iceberg form).
    A group of a pair holds the product of two degrees, so theta > 0 suits graphs with hubs.
    """
    ship(spark)
    n = adj.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("deg"))
    p, q = n.select(F.col("id").alias("x"), F.col("deg").alias("dx")), n.select(F.col("id").alias("y"), F.col("deg").alias("dy"))
    ratio = F.least("dx", "dy") / F.greatest("dx", "dy")
    first = {"ratio": ratio, "binary": F.when(F.col("dx") == F.col("dy"), 1.0).otherwise(0.0), "identity": F.lit(0.0)}[start]
    pairs = p.join(q, (F.col("x") < F.col("y")) & (F.least("dx", "dy") >= theta * F.greatest("dx", "dy")))
    pairs = written(pairs.withColumn("s", first), spark, "matched")
    na = adj.select(F.col("u").alias("x"), F.col("v").alias("a"))
    nb = adj.select(F.col("u").alias("y"), F.col("v").alias("b"))
    da, db = n.select(F.col("id").alias("a"), F.col("deg").alias("da")), n.select(F.col("id").alias("b"), F.col("deg").alias("db"))
    for _ in range(rounds):
        s = pairs.select(F.col("x").alias("lo"), F.col("y").alias("hi"), "s")
        ab = pairs.select("x", "y").join(na, "x").join(nb, "y").join(da, "a").join(db, "b")
        ab = ab.join(s, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left")
        pruned = F.lit(alpha) * F.least("da", "db") / F.greatest("da", "db") if theta > 0 else F.lit(0.0)
        ab = ab.select("x", "y", "a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce("s", pruned)).alias("s"))
        w = ab.groupBy("x", "y").applyInPandas(_weights, "x BIGINT, y BIGINT, w DOUBLE")
        pairs = written(pairs.drop("s").join(w, ["x", "y"], "left").withColumn("s", beta * F.coalesce("w", F.lit(0.0)) / F.greatest("dx", "dy") + (1 - beta)).drop("w"), spark, "matched")
    return pairs.select("x", "y", "s")
