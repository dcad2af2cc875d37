"""Recursive structural features: rounds of neighbourhood aggregates, pruned by correlation, then cut into quantile bins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.shared import written

Aggregates = dict[str, Callable[[Column], Column]]
#: Features have six decimals. Their sums and means are taken over whole millionths, so that halves round up whatever the order of rows.
UNIT = 1e6


def _whole(x: Column) -> Column:
    return F.round(x * UNIT).cast("decimal(20,0)")


def _sum_of(s: Column, n: Column) -> Column:
    return s.cast("double") / UNIT


def _mean_of(s: Column, n: Column) -> Column:
    half_up = F.call_function("div", 2 * F.abs(s) + n, F.greatest(2 * n, F.lit(1)))
    return F.when(s < 0, -half_up).otherwise(half_up).cast("double") / UNIT


def exact_sum(x: Column) -> Column:
    return _sum_of(F.sum(_whole(x)), F.count(x))


def exact_mean(x: Column) -> Column:
    return _mean_of(F.sum(_whole(x)), F.count(x))


#: Aggregates that follow from the sum of whole millionths and the count. A node's millionths are split once, at PART, into two
#: 64-bit numbers, so that edges add these and no decimals.
TOTALS = {exact_sum: _sum_of, exact_mean: _mean_of}
PART = 10**9


def _split(c: str) -> list[Column]:
    w = _whole(F.col(c).cast("double"))
    return [F.call_function("div", w, F.lit(PART)).alias(f"{c}__hi"), (w % F.lit(PART)).cast("bigint").alias(f"{c}__lo")]


def _total(c: str) -> Column:
    return (F.sum(f"{c}__hi").cast("decimal(20,0)") * F.lit(PART).cast("decimal(10,0)") + F.sum(f"{c}__lo").cast("decimal(20,0)")).cast("decimal(30,0)")


SIMPLE: Aggregates = {"s": exact_sum, "m": exact_mean}
COMPLEX: Aggregates = {
    "lo": F.min,
    "sd": F.stddev_pop,
    "va": F.var_pop,
    "m": F.avg,
    "p25": lambda x: F.percentile(x, 0.25),
    "p50": lambda x: F.percentile(x, 0.5),
    "hi": F.max,
    "sk": F.skewness,
    "ku": F.kurtosis,
}


def recursive_features(spark: SparkSession, adj: DataFrame, base: DataFrame, rounds: int = 3, threshold: float = 0.5, aggregates: Aggregates = SIMPLE) -> tuple[DataFrame, list[str]]:
    """(id, columns) of all rounds, divided by the range of all values, and the names of the columns.

    base has id and the features of round 0. A round aggregates each column of the round before over the neighbours and
    leaves out what correlates with a column of that round by more than the threshold; undefined correlations keep a
    column. One aggregate gives all correlations of a round: as many numbers as pairs of columns reach the driver.
    """
    now = written(base, spark, "features")
    rows, names = now, [c for c in now.columns if c != "id"]
    last = list(names)
    for _ in range(rounds):
        new = [f"{c}_{k}" for c in last for k in aggregates]
        whole = all(f in TOTALS for f in aggregates.values())
        cells = now.select("id", *[x for c in last for x in _split(c)]) if whole else now
        value = {(c, k): TOTALS[f](_total(c), F.count(f"{c}__hi")) if whole else f(F.col(c).cast("double")) for c in last for k, f in aggregates.items()}
        grouped = adj.join(cells, adj.v == cells.id).groupBy(F.col("u").alias("id")).agg(*[F.round(x, 6).alias(f"{c}_{k}") for (c, k), x in value.items()])
        wide = written(grouped, spark, "features")
        both = wide.join(now, "id")
        r = both.agg(*[F.corr(o, n).alias(f"{i}_{j}") for i, o in enumerate(last) for j, n in enumerate(new)]).first()
        kept = [n for j, n in enumerate(new) if not any(x is not None and x == x and abs(x) > threshold for x in (r[f"{i}_{j}"] for i in range(len(last))))]
        if not kept:
            break
        now, last = wide.select("id", *kept), kept
        rows, names = rows.join(now, "id", "left"), names + kept
    rows = written(rows.select("id", *[F.col(c).cast("double").alias(c) for c in names]), spark, "features")
    ends = rows.agg(F.max(F.greatest(*names)).alias("hi"), F.min(F.least(*names)).alias("lo")).first()
    span = (ends["hi"] or 0.0) - (ends["lo"] or 0.0) or 1.0
    return rows.select("id", *[(F.col(c) / span).alias(c) for c in names]), names


def quantile_bins(rows: DataFrame, names: list[str], bins: int = 4) -> DataFrame:
    """(id, col, bin) of the columns whose bin edges all differ; bins are closed on the right, the first on both sides."""
    at = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    edges = rows.agg(*[F.percentile(c, at).alias(c) for c in names]).first()
    good = [c for c in names if edges[c] and len(set(edges[c])) == bins + 1]

    def bin_of(c: str) -> Column:
        return sum(((F.col(c) > F.lit(x)).cast("int") for x in edges[c][1:-1]), F.lit(0))

    cells = [F.struct(F.lit(c).alias("col"), bin_of(c).cast("int").alias("bin")) for c in good]
    return rows.select("id", F.explode(F.array(*cells)).alias("x")).select("id", "x.col", "x.bin") if good else rows.select("id", F.lit("").alias("col"), F.lit(0).alias("bin")).limit(0)
