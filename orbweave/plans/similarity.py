"""Similarities of nodes and the layered context graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.dialect import graph, oracle, query, ranked
from orbweave.operators.pairs import met, numbered
from orbweave.plans.features import BFS

G = graph()
#: Candidate pairs: each node with the 2 log2(n) nodes after it in the order of degrees, so that a node has as many on
#: both sides. Ranks are cut into cells of that length, and pairs stand in one cell or in neighbouring ones.
CAND = (
    f"dq AS (SELECT id, deg, cast(floor(id / 4096.0) AS BIGINT) AS cell FROM n), {ranked('dq', 'deg, cell', 'x.id')}, kk AS (SELECT cast(ceil(2 * ln(count(*)) / ln(2)) AS BIGINT) AS k FROM n), "
    "oc AS (SELECT id, deg, r, k, cast(floor(r / cast(k AS DOUBLE)) AS BIGINT) AS c FROM rk CROSS JOIN kk), "
    "cand AS (SELECT a.id AS x, b.id AS y, a.deg AS dx, b.deg AS dy FROM (SELECT oc.*, c + t AS t FROM oc CROSS JOIN (SELECT 0 AS t UNION ALL SELECT 1) s) a JOIN oc b ON b.c = a.t AND b.r > a.r AND b.r <= a.r + a.k)"
)
SQL = {
    "m02_degree_ratio_init": f"{G}, {CAND} SELECT x, y, round(least(dx, dy) / cast(greatest(dx, dy) AS DOUBLE), 6) AS s FROM cand",
    "m02_binary_init": f"{G}, {CAND} SELECT x, y, CASE WHEN dx = dy THEN 1.0 ELSE 0.0 END AS s FROM cand",
    "m05_iceberg_candidates": f"{G}, {CAND} SELECT x, y, round(0.5 * least(dx, dy) / cast(greatest(dx, dy) AS DOUBLE), 6) AS estimate FROM cand WHERE least(dx, dy) >= 0.8 * greatest(dx, dy)",
    "m06_l1_change": f"{G}, {CAND} SELECT round(avg(abs(least(dx, dy) / cast(greatest(dx, dy) AS DOUBLE) - CASE WHEN dx = dy THEN 1.0 ELSE 0.0 END)), 6) AS change FROM cand",
    "m07_simrank_round": f"{G} SELECT a.v AS x, b.v AS y, round(sum(0.9 / (p.deg * q.deg)) + 1e-9, 5) AS s FROM adj a JOIN adj b ON a.u = b.u JOIN n p ON p.id = a.v JOIN n q ON q.id = b.v WHERE a.v < b.v GROUP BY a.v, b.v",
    "m08_sampled_pairs": f"{G}, {CAND}, s AS (SELECT x, y, least(dx, dy) / cast(greatest(dx, dy) AS DOUBLE) AS s FROM cand), r AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS hi, row_number() OVER (PARTITION BY x ORDER BY md5(concat(x, '-', y))) AS k FROM s) SELECT p.x AS i, p.y AS pos, q.y AS neg FROM r p JOIN r q ON q.x = p.x AND q.hi > 4 AND q.k = p.hi WHERE p.hi BETWEEN 2 AND 4",
    "m09_ranked_pairs": f"{G}, {CAND}, s AS (SELECT x, y, least(dx, dy) / cast(greatest(dx, dy) AS DOUBLE) AS s FROM cand), r AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS hi, row_number() OVER (PARTITION BY x ORDER BY s, y) AS lo FROM s) SELECT p.x AS i, p.y AS pos, q.y AS neg FROM r p JOIN r q ON q.x = p.x AND q.lo = p.hi WHERE p.hi <= 3",
    "m12_degree_candidates": f"{G}, {CAND} SELECT x, y FROM cand",
    "m17_shortest_path_kernel": f"{G}, {CAND}, {BFS}, h AS (SELECT root, d, count(*) AS c FROM hop GROUP BY root, d), k AS (SELECT x, y, sum(p.c * q.c) AS xy FROM cand JOIN h p ON p.root = x JOIN h q ON q.root = y AND q.d = p.d GROUP BY x, y), s AS (SELECT root, sum(c * c) AS k FROM h GROUP BY root) SELECT x, y, round(xy / sqrt(cast(a.k AS DOUBLE) * b.k), 6) AS kernel FROM k JOIN s a ON a.root = x JOIN s b ON b.root = y",
    "m20_normalised_kernel": f"{G}, c AS (SELECT a.v AS x, b.v AS y, count(*) AS c FROM adj a JOIN adj b ON a.u = b.u GROUP BY a.v, b.v) SELECT c.x, c.y, round(coalesce(c.c / nullif(sqrt(cast(p.deg AS DOUBLE) * q.deg), 0), 0), 6) AS k FROM c JOIN n p ON p.id = c.x JOIN n q ON q.id = c.y WHERE c.x < c.y",
    "m21_vector_distance": "SELECT a.vec_id AS x, b.vec_id AS y, round(sqrt(@sq_dist(a.embedding, b.embedding)@), 4) AS d FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id",
    "f17_second_order_similarity": f"{G}, c AS (SELECT a.v AS x, b.v AS y, count(*) AS c FROM adj a JOIN adj b ON a.u = b.u WHERE a.v < b.v GROUP BY a.v, b.v) SELECT x, y, round(c / cast(p.deg + q.deg - c AS DOUBLE), 6) AS s FROM c JOIN n p ON p.id = x JOIN n q ON q.id = y",
    "f20_feature_gram": f"{G}, c AS (SELECT a.v AS x, b.v AS y, count(*) AS c FROM adj a JOIN adj b ON a.u = b.u GROUP BY a.v, b.v) SELECT x, y, c FROM c WHERE x <= y",
    "f27_pyramid_match": f"{G}, {CAND}, h AS (SELECT adj.u AS id, l.l, cast(floor(n.deg / power(2, l.l)) AS BIGINT) AS b, count(*) AS c FROM adj JOIN n ON n.id = adj.v CROSS JOIN (SELECT 0 AS l UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) l GROUP BY 1, 2, 3) SELECT x, y, cast(sum(CASE WHEN p.l = 3 THEN least(p.c, q.c) ELSE 0 END) AS BIGINT) AS coarse, cast(sum(CASE WHEN p.l = 0 THEN least(p.c, q.c) ELSE 0 END) AS BIGINT) AS fine FROM cand JOIN h p ON p.id = x JOIN h q ON q.id = y AND q.l = p.l AND q.b = p.b GROUP BY x, y",
}


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes in the order of CAND, by which pairs are met."""
    return query(f"{G}, {CAND} SELECT id, r, k, c FROM oc")(spark, sf_dir)


def pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours that two nodes have in the same bin of degrees, in bins of eight and of one. Bins of eight hold the finer
    ones, so that pairs without a common bin at any level are those without one of eight."""
    near = query(f"{G} SELECT u, deg FROM adj JOIN n ON n.id = v")(spark, sf_dir).repartition("u")
    bins = near.select("u", F.col("deg").cast("long").alias("b")).groupBy("u", "b").agg(F.count("*").alias("c"))
    wide = bins.groupBy("u", F.floor(F.col("b") / 8).alias("b")).agg(F.sum("c").alias("c"), F.collect_list(F.struct("b", "c")).alias("z"))
    bags = wide.groupBy(F.col("u").alias("id")).agg(numbered(F.collect_list(F.struct("b", "c"))).alias("coarse"), numbered(F.flatten(F.collect_list("z"))).alias("fine"))
    common = met(candidates(spark, sf_dir), bags).select("x", "y", *[F.size(F.array_intersect(f"p.{c}", f"q.{c}")).cast("long").alias(c) for c in ("coarse", "fine")])
    return common.where("coarse > 0")


QUERIES = {k: query(v) for k, v in SQL.items()} | {"f27_pyramid_match": pyramid}
ORACLES = {k: oracle(v) for k, v in SQL.items()}
