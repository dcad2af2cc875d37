"""Queries of operators that iterate or need Arrow batches. They have no SQL; tests hold brute-force versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.dialect import graph, oracle, query
from orbweave.functions.shared import ship
from orbweave.operators.cores import core_numbers
from orbweave.operators.matching import matched_similarity
from orbweave.operators.paths import betweenness, closeness, levels
from orbweave.operators.refex import quantile_bins, recursive_features
from orbweave.operators.regression import regressive_features
from orbweave.operators.warping import warping_distance
from orbweave.plans.features import EGO
from orbweave.plans.similarity import CAND
from orbweave.plans.wavelets import whole_graph


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """adj(u, v) of the tree of nations and their regions."""
    e = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.col("n_nationkey") + 1000).cast("bigint").alias("u"), F.col("n_regionkey").cast("bigint").alias("v"))
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core_numbers(spark, query(f"{graph()} SELECT u, v FROM adj")(spark, sf_dir), whole_graph(spark, sf_dir), query(f"{graph()} SELECT id, deg FROM n")(spark, sf_dir))


def closeness_of(spark: SparkSession, sf_dir: str, every: int = 50) -> DataFrame:
    """Levels of the nodes whose id is divisible by `every`, to any distance."""
    adj, nodes = query(f"{graph()} SELECT u, v FROM adj")(spark, sf_dir), query(f"{graph()} SELECT id FROM n")(spark, sf_dir)
    return closeness(levels(spark, adj, nodes.where(F.col("id") % every == 0)), nodes.count()).withColumn("closeness", F.round("closeness", 6))


def betweenness_of(spark: SparkSession, sf_dir: str, every: int = 50) -> DataFrame:
    """Paths from the nodes whose id is divisible by `every` to all nodes, as they pass every node."""
    adj, nodes = query(f"{graph()} SELECT u, v FROM adj")(spark, sf_dir), query(f"{graph()} SELECT id FROM n")(spark, sf_dir)
    return betweenness(spark, whole_graph(spark, sf_dir), adj, nodes.where(F.col("id") % every == 0), nodes).withColumn("betweenness", F.round("betweenness", 5))


def warping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of close degrees with the distance of their neighbours' compact degree sequences."""
    ship(spark)
    seq = query(f"{graph()} SELECT u, deg, count(*) AS c FROM adj JOIN n ON n.id = v GROUP BY u, deg")(spark, sf_dir)
    seq = seq.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("deg", "c"))).alias("z")).select("u", F.col("z.deg").alias("d"), F.col("z.c").alias("f"))
    cand = query(f"{graph()}, {CAND} SELECT x, y FROM cand")(spark, sf_dir)
    p, q = seq.select(F.col("u").alias("x"), F.col("d").alias("dp"), F.col("f").alias("fp")), seq.select(F.col("u").alias("y"), F.col("d").alias("dq"), F.col("f").alias("fq"))
    return cand.join(p, "x").join(q, "y").select("x", "y", F.round(warping_distance("dp", "fp", "dq", "fq"), 6).alias("distance"))


BASE = ("inside", "overall", "inside_ratio", "outside_ratio", "deg", "clustering")
EGO_ROWS = "SELECT id, inside, overall, inside / cast(overall AS DOUBLE) AS inside_ratio, (overall - inside) / cast(overall AS DOUBLE) AS outside_ratio, deg, CASE WHEN deg < 2 THEN 0.0 ELSE 2.0 * t / (deg * (deg - 1)) END AS clustering FROM ego"


def refex(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Three rounds over the egonet features of the graph."""
    base = query(f"{graph()}, {EGO} {EGO_ROWS}")(spark, sf_dir)
    base = base.select("id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in BASE])
    return recursive_features(spark, query(f"{graph()} SELECT u, v FROM adj")(spark, sf_dir), base)


def regressive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Degree, edges inside the egonet and edges that leave it, and what two rounds add to them."""
    ship(spark)
    base = query(f"{graph()}, {EGO} SELECT id, deg, inside, overall - 2 * inside AS leaving FROM ego")(spark, sf_dir)
    return regressive_features(spark, query(f"{graph()} SELECT u, v FROM adj")(spark, sf_dir), base.select("id", *[F.col(c).cast("double").alias(c) for c in ("deg", "inside", "leaving")]), 2)


def regressive_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = regressive(spark, sf_dir)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.round(F.coalesce(c, F.lit(0.0)), 6).alias("x")) for c in names])).alias("c")
    return rows.select("id", cells).select("id", "c.col", "c.x")


def refex_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = refex(spark, sf_dir)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.round(F.col(c) + 1e-12, 9).alias("x")) for c in names])).alias("c")
    return rows.select("id", cells).select("id", "c.col", "c.x").where("x IS NOT NULL")


def refex_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantile_bins(*refex(spark, sf_dir))


def _refex_sql(rounds: int = 3, threshold: float = 0.5) -> str:
    """The same rounds with a row for each value of a node, pruned by an anti join."""
    out = [f"base AS ({EGO_ROWS})", "k0 AS (" + " UNION ALL ".join(f"SELECT id, '{c}' AS col, round({c} * 1.0, 6) AS x FROM base" for c in BASE) + ")"]
    for i in range(1, rounds + 1):
        o = f"k{i - 1}"
        out.append(f"a{i} AS (SELECT adj.u AS id, col, sum(x) AS s, avg(x) AS m FROM adj JOIN {o} ON {o}.id = adj.v GROUP BY 1, 2)")
        out.append(f"c{i} AS (SELECT id, concat(col, '_s') AS col, round(s, 6) AS x FROM a{i} UNION ALL SELECT id, concat(col, '_m'), round(m, 6) FROM a{i})")
        out.append(f"g{i} AS (SELECT b.col FROM c{i} b JOIN {o} o ON o.id = b.id GROUP BY o.col, b.col HAVING var_pop(o.x) > 0 AND var_pop(b.x) > 0 AND abs(corr(o.x, b.x)) > {threshold})")
        out.append(f"k{i} AS (SELECT * FROM c{i} WHERE col NOT IN (SELECT col FROM g{i}))")
    out.append("ka AS (" + " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(rounds + 1)) + "), sp AS (SELECT max(x) - min(x) AS w FROM ka), f AS (SELECT id, col, x / w AS x FROM ka CROSS JOIN sp)")
    return f"{graph()}, {EGO}, " + ", ".join(out)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("s", F.round("s", 6))


QUERIES = {
    "f23_core_numbers": cores,
    "f23_closeness": closeness_of,
    "f23_betweenness": betweenness_of,
    "m01_role_similarity": lambda spark, sf_dir: _rounded(matched_similarity(spark, regions(spark, sf_dir), 3)),
    "m04_match_similarity": lambda spark, sf_dir: _rounded(matched_similarity(spark, regions(spark, sf_dir), 3, beta=1.0, start="identity")),
    "m05_iceberg_similarity": lambda spark, sf_dir: _rounded(matched_similarity(spark, regions(spark, sf_dir), 3, theta=0.5)),
    "m10_warping_distance": warping,
    "f05_recursive_features": refex_long,
    "f07_recursive_bins": refex_bins,
    "f25_regressive_features": regressive_long,
}
#: Walks of up to eight edges from the roots; the least length of one is a distance, as far as distances go.
_PATHS = f"{graph().replace('WITH ', 'WITH RECURSIVE ', 1)}, walked AS (SELECT id AS root, id AS node, 0 AS d FROM n WHERE id % 50 = 0 UNION SELECT root, v, d + 1 FROM walked JOIN adj ON adj.u = node WHERE d < 8), far AS (SELECT root, node, min(d) AS d FROM walked GROUP BY root, node)"
ORACLES: dict[str, str] = {
    "f23_closeness": oracle(f"{_PATHS} SELECT root AS id, count(*) - 1 AS reached, max(d) AS far, round(coalesce((count(*) - 1.0) * (count(*) - 1) / nullif(sum(d) * (SELECT count(*) - 1 FROM n), 0), 0), 6) AS closeness FROM far GROUP BY root"),
    "f05_recursive_features": oracle(f"{_refex_sql()} SELECT id, col, round(x + 1e-12, 9) AS x FROM f"),
    "f07_recursive_bins": oracle(f"{_refex_sql()}, q AS (SELECT col, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS b, quantile_cont(x, 0.75) AS c FROM f GROUP BY col) SELECT id, f.col, CASE WHEN x <= a THEN 0 WHEN x <= b THEN 1 WHEN x <= c THEN 2 ELSE 3 END AS bin FROM f JOIN q ON q.col = f.col WHERE lo < a AND a < b AND b < c AND c < hi"),
}
