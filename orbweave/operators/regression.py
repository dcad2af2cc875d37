"""Least squares over columns by their inner products: features that earlier ones don't span, and measures as sums of roles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.shared import written


def inner_products(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """Sums over rows of the products of any two columns, null as 0; a partition sends one row of len(columns) ** 2 values."""
    k = len(columns)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for b in batches:
            x = b.to_numpy(dtype=float)
            total += x.T @ x
        yield pd.DataFrame({"s": [total.ravel()]})

    wide = rows.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    return sum((np.array(r["s"]).reshape(k, k) for r in wide.mapInPandas(sums, "s ARRAY<DOUBLE>").collect()), np.zeros((k, k)))


def independent(g: np.ndarray, tolerance: float = 1e-5) -> list[int]:
    """The columns, first to last, of which more than `tolerance` of the length is left by least squares on those taken
    before. Inner products in doubles don't tell shares below about 1e-7 from none."""
    scale = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1))
    g = g / np.outer(scale, scale)
    taken: list[int] = []
    for j in range(len(g)):
        if g[j, j] <= 0:
            continue
        fit = np.linalg.lstsq(g[np.ix_(taken, taken)], g[taken, j], rcond=1e-14)[0] if taken else np.empty(0)
        if max(0.0, 1 - 2 * fit @ g[taken, j] + fit @ g[np.ix_(taken, taken)] @ fit) > tolerance**2:
            taken.append(j)
    return taken


def regressive_features(spark: SparkSession, adj: DataFrame, base: DataFrame, rounds: int = 3, tolerance: float = 1e-5) -> tuple[DataFrame, list[str]]:
    """base(id, ..) and, round by round, sums (_s) and means (_m) over neighbours of the columns new in the round before,
    each kept where the columns kept before don't span it."""
    names = [c for c in base.columns if c != "id"]
    rows = written(base, spark, "regressive")
    names = [names[j] for j in independent(inner_products(rows, names), tolerance)]
    new = names
    for _ in range(rounds):
        if not new:
            break
        sums = adj.join(rows.select("id", *new), F.col("v") == F.col("id")).groupBy("u").agg(*[f(c).alias(c + n) for c in new for n, f in (("_s", F.sum), ("_m", F.avg))])
        more = [c for c in sums.columns if c != "u"]
        wide = written(rows.select("id", *names).join(sums.withColumnRenamed("u", "id"), "id", "left"), spark, "regressive")
        everything = names + more
        kept = [everything[j] for j in independent(inner_products(wide, everything), tolerance)]
        new = [c for c in kept if c in set(more)]
        names, rows = names + new, wide
    return rows.select("id", *names), names


def nonnegative_least_squares(g: np.ndarray, b: np.ndarray, sweeps: int = 5000) -> np.ndarray:
    """x >= 0 with the least x'gx / 2 - b'x, one coordinate after the other."""
    x = np.zeros(len(b))
    for _ in range(sweeps):
        before = x.copy()
        for i in range(len(b)):
            if g[i, i] > 0:
                x[i] = max(0.0, x[i] + (b[i] - g[i] @ x) / g[i, i])
        if np.abs(x - before).max(initial=0.0) <= 1e-13 * max(1.0, np.abs(x).max(initial=0.0)):
            break
    return x


def explained(spark: SparkSession, rows: DataFrame, roles: list[str], measures: list[str]) -> DataFrame:
    """(measure, role, weight, relative): non-negative weights of roles whose sum is nearest a measure over all rows, and
    the weight over that of one role which all rows have alike."""
    g = inner_products(rows.withColumn("_one", F.lit(1.0)), [*roles, *measures, "_one"])
    k, out = len(roles), []
    for j, m in enumerate(measures):
        x = nonnegative_least_squares(g[:k, :k], g[:k, k + j])
        mean = g[-1, k + j] / g[-1, -1] if g[-1, -1] else 0.0
        out += [(m, r, float(x[i]), float(x[i] / mean) if mean else None) for i, r in enumerate(roles)]
    return spark.createDataFrame(out, "measure STRING, role STRING, weight DOUBLE, relative DOUBLE")
