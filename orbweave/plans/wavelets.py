"""Wavelets and signatures of nodes whose id is divisible by 50, over the whole graph, at the two automatic scales."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.dialect import graph, oracle, query
from orbweave.operators.graph_blocks import placed
from orbweave.operators.heat import ETA_HIGH, ETA_LOW, ORDER, heat_columns, scales

_graphs: dict[tuple[str, str], str] = {}


def whole_graph(spark: SparkSession, sf_dir: str) -> str:
    """The folder of placed() of the graph, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _graphs:
        _graphs[key] = placed(spark, query(f"{graph()} SELECT u, v FROM adj")(spark, sf_dir))
    return _graphs[key]


def heat(spark: SparkSession, sf_dir: str, finish, schema: str) -> DataFrame:
    """finish(n, source, scale number, nodes, values) of the entries above 1e-4 / n of every wavelet that has any."""
    path = whole_graph(spark, sf_dir)
    nodes = query(f"{graph()} SELECT id FROM n")(spark, sf_dir)
    n = nodes.count()

    def above(j: int, s: int, i: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        kept = x > 1e-4 / max(n, 1)
        if kept.all():
            yield finish(n, j, s, i, x)
        elif kept.any():
            yield finish(n, j, s, i[kept], x[kept])

    return heat_columns(spark, path, nodes.where("id % 50 = 0"), scales(n), above, schema)


def _rows(j: int, s: int, **columns: np.ndarray) -> pa.RecordBatch:
    k = len(next(iter(columns.values())))
    return pa.RecordBatch.from_pydict({"j": np.full(k, j), "s": np.full(k, s, np.int32), **columns})


def _entries_of(n: int, j: int, s: int, i: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    # Half up, as the SQL rounds; values are above 0. Here and not in Spark, whose round() goes through decimals value by value.
    return pa.RecordBatch.from_pydict({"j": np.full(len(i), j), "i": i, "s": np.full(len(i), s, np.int32), "x": np.floor((x + 1e-10) * 1e7 + 0.5) / 1e7})


#: Angle up to which turned() takes power sums, and their number: what the series leaves out is below 2e-14 a value.
NARROW, POWERS = 0.5, 12


def turned(x: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The sums of exp(i t x) over x, not negative, for each of the times t: by power sums where the largest angle is small."""
    most = max(float(times.max()), 1e-300)
    small = x <= NARROW / most
    out = np.exp(1j * np.multiply.outer(times, x[~small])).sum(1)
    y = x[small] * most
    power, term = np.ones_like(y), np.ones(len(times), complex)
    for k in range(POWERS + 1):
        if k:
            power *= y
            term = term * (1j * times / most) / k
        out += term * power.sum()
    return out


def _characteristic_of(n: int, j: int, s: int, i: np.ndarray, x: np.ndarray, points: int) -> pa.RecordBatch:
    z = turned(x, np.arange(points) * (100.0 / (points - 1)))
    return _rows(j, s, k=np.arange(points, dtype=np.int32), re=(n - len(x) + z.real) / n, im=z.imag / n)


def characteristic(spark: SparkSession, sf_dir: str, points: int) -> DataFrame:
    """(id, s, k, re, im): the empirical characteristic function of a column at `points` times from 0 to 100, zeros included."""
    h = heat(spark, sf_dir, lambda *a: _characteristic_of(*a, points), "j BIGINT, s INT, k INT, re DOUBLE, im DOUBLE")
    return h.select(F.col("j").alias("id"), "s", "k", F.round(F.col("re") + 1e-9, 5).alias("re"), F.round(F.col("im") + 1e-9, 5).alias("im"))


def _entropy_of(n: int, j: int, s: int, i: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    off = x[i != j]
    return _rows(j, s, entropy=np.array([-(x @ np.log(x))]), variance=pa.array([float(off.var()) if len(off) else None], pa.float64()))


def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = heat(spark, sf_dir, _entropy_of, "j BIGINT, s INT, entropy DOUBLE, variance DOUBLE")
    return h.select(F.col("j").alias("id"), "s", F.round(F.col("entropy") + 1e-9, 5).alias("entropy"), F.round(F.col("variance") * 1e6 + 1e-9, 4).alias("variance"))


def _angle_of(n: int, j: int, s: int, i: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    z = turned(x, np.ones(1))
    return _rows(j, s, angle=np.arctan(z.imag / (n - len(x) + z.real)))


def angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = heat(spark, sf_dir, _angle_of, "j BIGINT, s INT, angle DOUBLE")
    return h.select(F.col("j").alias("id"), "s", F.round(F.col("angle") * 1e3 + 1e-9, 5).alias("angle"))


QUERIES = {
    "h04_heat": lambda spark, sf_dir: heat(spark, sf_dir, _entries_of, "j BIGINT, i BIGINT, s INT, x DOUBLE"),
    "h06_characteristic": lambda spark, sf_dir: characteristic(spark, sf_dir, 5),
    "h08_entropy": entropy,
    "h09_angle": angle,
    "e03_wavelet_signatures": lambda spark, sf_dir: characteristic(spark, sf_dir, 25),
}


def _sql() -> str:
    """Every power of the polynomials as a table of its own, from the recurrence, and coefficients summed in SQL."""
    out = ["p AS MATERIALIZED (SELECT adj.u, adj.v, 1 / sqrt(cast(a.deg AS DOUBLE) * b.deg) AS w FROM adj JOIN n a ON a.id = adj.u JOIN n b ON b.id = adj.v)"]
    out.append("t0 AS MATERIALIZED (SELECT id AS j, id AS i, cast(1 AS DOUBLE) AS x FROM n WHERE id % 50 = 0)")
    out.append("t1 AS MATERIALIZED (SELECT t.j, p.v AS i, -sum(w * x) AS x FROM t0 t JOIN p ON p.u = t.i GROUP BY 1, 2)")
    for k in range(2, ORDER + 1):
        out.append(f"t{k} AS MATERIALIZED (SELECT j, i, sum(x) AS x FROM (SELECT t.j, p.v AS i, -2 * w * x AS x FROM t{k - 1} t JOIN p ON p.u = t.i UNION ALL SELECT j, i, -x FROM t{k - 2}) y GROUP BY 1, 2)")
    out.append(f"sc AS (SELECT 0 AS s, -ln({ETA_LOW}) * sqrt(0.5 * count(*)) AS tau, count(*) AS n FROM n UNION ALL SELECT 1, -ln({ETA_HIGH}) * sqrt(0.5 * count(*)), count(*) FROM n)")
    out.append(f"co AS (SELECT k.range AS k, s, n, sum(2.0 / {ORDER} * cos(k.range * pi() * (2 * m.range + 1) / {2 * ORDER}) * exp(-tau * (cos(pi() * (2 * m.range + 1) / {2 * ORDER}) + 1))) * (CASE WHEN k.range = 0 THEN 0.5 ELSE 1 END) AS c FROM range({ORDER + 1}) k, range({ORDER}) m, sc GROUP BY 1, 2, 3)")
    out.append("al AS (" + " UNION ALL ".join(f"SELECT {k} AS k, j, i, x FROM t{k}" for k in range(ORDER + 1)) + ")")
    out.append("heat AS (SELECT j, i, s, sum(c * x) AS x, max(n) AS n FROM al JOIN co USING (k) GROUP BY 1, 2, 3 HAVING sum(c * x) > 1e-4 / max(n))")
    return f"{graph()}, " + ", ".join(out)


def _characteristic(points: int) -> str:
    return f"{_sql()} SELECT j AS id, s, t.range::INTEGER AS k, round((max(n) - count(*) + sum(cos(t.range * 100.0 / {points - 1} * x))) / max(n) + 1e-9, 5) AS re, round(sum(sin(t.range * 100.0 / {points - 1} * x)) / max(n) + 1e-9, 5) AS im FROM heat, range({points}) t GROUP BY 1, 2, 3"


ORACLES = {
    "h04_heat": oracle(f"{_sql()} SELECT j, i, s, round(x + 1e-10, 7) AS x FROM heat"),
    "h06_characteristic": oracle(_characteristic(5)),
    "h08_entropy": oracle(f"{_sql()} SELECT j AS id, s, round(-sum(x * ln(x)) + 1e-9, 5) AS entropy, round(var_pop(CASE WHEN i <> j THEN x END) * 1e6 + 1e-9, 4) AS variance FROM heat GROUP BY 1, 2"),
    "h09_angle": oracle(f"{_sql()} SELECT j AS id, s, round(atan(sum(sin(x)) / (max(n) - count(*) + sum(cos(x)))) * 1e3 + 1e-9, 5) AS angle FROM heat GROUP BY 1, 2"),
    "e03_wavelet_signatures": oracle(_characteristic(25)),
}
