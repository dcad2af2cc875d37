"""Kernels of egonets by subtree labels, and node vectors from the kernel to a set of landmarks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.dialect import graph, oracle, query
from orbweave.functions.shared import written
from orbweave.plans.features import TRI
from orbweave.plans.similarity import CAND

G = graph()
ROUNDS = 4
#: The edges of every egonet, both ways, from edges and triangles: no path of two edges is expanded.
_INSIDE = "SELECT u AS root, u AS x, v AS y FROM adj UNION ALL SELECT u, v, u FROM adj" + "".join(f" UNION ALL SELECT {r}, {a}, {b} FROM t3" for r, a, b in ("xyz", "xzy", "yxz", "yzx", "zxy", "zyx"))


def subtree_labels(rounds: int = ROUNDS) -> str:
    """hw(root, l, c): counts of labels in an egonet of radius 1 over all rounds; labels begin as distances from the root
    and are joined, inside the egonet, with the sorted labels of neighbours. sw(root, s) is the length of the counts."""
    out = [TRI, f"ee AS ({_INSIDE})", "l0 AS (SELECT id AS root, id AS node, '0' AS l FROM n UNION ALL SELECT u, v, '1' FROM adj)"]
    for i in range(1, rounds + 1):
        out.append(f"l{i} AS (SELECT o.root, o.node, md5(concat(max(o.l), '_', @list(b.l)@)) AS l FROM l{i - 1} o JOIN ee ON ee.root = o.root AND ee.x = o.node JOIN l{i - 1} b ON b.root = ee.root AND b.node = ee.y GROUP BY o.root, o.node)")
    out.append("hw AS (SELECT root, l, count(*) AS c FROM (" + " UNION ALL ".join(f"SELECT root, l FROM l{i}" for i in range(rounds + 1)) + ") a GROUP BY root, l)")
    return ", ".join([*out, "sw AS (SELECT root, sqrt(cast(sum(c * c) AS DOUBLE)) AS s FROM hw GROUP BY root)"])


def landmark_vectors(spark: SparkSession, counts: DataFrame, m: int = 32, dim: int = 16) -> DataFrame:
    """(id, x): Nystrom vectors from counts(root, l, c). The m landmarks are the first nodes by hash; the kernel is
    normalised; inner products of vectors are the kernel itself between landmarks where dim reaches its rank.

    The driver holds m x m kernel values. Axes are the strongest first, each with its largest weight positive.
    """
    size = counts.groupBy("root").agg(F.sqrt(F.sum(F.col("c") * F.col("c")).cast("double")).alias("s"))
    marks = written(size.orderBy(F.md5(F.col("root").cast("string")), "root").limit(m).select(F.col("root").alias("mark"), F.col("s").alias("sm")), spark, "landmarks")
    of_marks = counts.join(marks, counts["root"] == marks["mark"], "left_semi").select(F.col("root").alias("mark"), "l", F.col("c").alias("cm"))
    k = counts.join(of_marks, "l").groupBy("root", "mark").agg(F.sum(F.col("c") * F.col("cm")).alias("k"))
    k = written(k.join(size, "root").join(marks, "mark").select("root", "mark", (F.col("k") / (F.col("s") * F.col("sm"))).alias("k")), spark, "to-landmarks")
    ids = sorted(r["mark"] for r in marks.collect())
    at = {x: i for i, x in enumerate(ids)}
    inner = np.zeros((len(ids), len(ids)))
    for r in k.join(marks.select(F.col("mark").alias("root")), "root", "left_semi").collect():
        inner[at[r["root"]], at[r["mark"]]] = r["k"]
    values, axes = np.linalg.eigh((inner + inner.T) / 2)
    keep = [i for i in np.argsort(-values, kind="stable")[:dim] if values[i] > 1e-9]
    w = axes[:, keep] / np.sqrt(values[keep])
    w = w * np.sign(w[np.abs(w).argmax(axis=0), np.arange(len(keep))]) if len(keep) else w
    weights = spark.createDataFrame([(x, w[i].tolist()) for x, i in at.items()], "mark BIGINT, w ARRAY<DOUBLE>")
    sums = k.join(weights, "mark").groupBy("root").agg(*[F.sum(F.col("k") * F.col("w")[j]).alias(f"x{j}") for j in range(len(keep))] or [F.count("*").alias("x")])
    return sums.select(F.col("root").alias("id"), F.array(*[F.round(f"x{j}", 6) for j in range(len(keep))]).cast("array<double>").alias("x"))


def egonet_vectors(spark: SparkSession, sf_dir: str, m: int = 32, dim: int = 16) -> DataFrame:
    return landmark_vectors(spark, query(f"{G}, {subtree_labels()} SELECT root, l, c FROM hw")(spark, sf_dir), m, dim)


SQL = {
    "m18_wl_kernel": f"{G}, {CAND}, {subtree_labels()} SELECT x, y, round(sum(p.c * q.c) / (max(a.s) * max(b.s)), 6) AS kernel FROM cand JOIN hw p ON p.root = x JOIN hw q ON q.root = y AND q.l = p.l JOIN sw a ON a.root = x JOIN sw b ON b.root = y GROUP BY x, y",
}
QUERIES = {k: query(v) for k, v in SQL.items()} | {"e04_egonet_vectors": egonet_vectors}
ORACLES = {k: oracle(v) for k, v in SQL.items()}
