"""Evaluation of embeddings: searches take every vector whose id is divisible by 50 as a query, against all vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.dialect import oracle, query
from orbweave.operators.nearest import nearest_of_other_folds

KNN = "d AS (SELECT q.vec_id AS q, q.label AS ql, b.vec_id AS b, b.label AS bl, @sq_dist(q.embedding, b.embedding)@ AS d FROM embeddings q JOIN embeddings b ON q.vec_id % 50 = 0 AND b.vec_id <> q.vec_id), r AS (SELECT q, ql, b, bl, row_number() OVER (PARTITION BY q ORDER BY round(d, 5), b) AS k FROM d)"
X = "x AS (SELECT vec_id, label, @dims(embedding)@ FROM embeddings), c AS (SELECT label, k, avg(x) AS m FROM x GROUP BY label, k)"
NEAR = f"{X}, s AS (SELECT x.vec_id, x.label, c.label AS cluster, sum((x.x - c.m) * (x.x - c.m)) AS d FROM x JOIN c ON c.k = x.k GROUP BY 1, 2, 3), a AS (SELECT vec_id, label, cluster FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 5), cluster) AS r FROM s) t WHERE r = 1)"
CONT = f"{NEAR}, t AS (SELECT label, cluster, cast(count(*) AS DOUBLE) AS n FROM a GROUP BY label, cluster), l AS (SELECT label, sum(n) AS n FROM t GROUP BY label), k AS (SELECT cluster, sum(n) AS n FROM t GROUP BY cluster), w AS (SELECT sum(n) AS n FROM t)"
SQL = {
    "v01_nearest_centroid_f1": f"WITH {NEAR}, c2 AS (SELECT label AS cls, sum(CASE WHEN label = cluster THEN 1 ELSE 0 END) AS tp, count(*) AS n FROM a GROUP BY label), p AS (SELECT cluster AS cls, count(*) AS n FROM a GROUP BY cluster) SELECT c2.cls, round(2.0 * tp / (c2.n + coalesce(p.n, 0)), 6) AS f1 FROM c2 LEFT JOIN p ON p.cls = c2.cls",
    "v02_nmi": f"WITH {CONT}, m AS (SELECT sum(t.n / w.n * ln(t.n * w.n / (l.n * k.n))) AS mi FROM t JOIN l ON l.label = t.label JOIN k ON k.cluster = t.cluster CROSS JOIN w), hl AS (SELECT -sum(l.n / w.n * ln(l.n / w.n)) AS h FROM l CROSS JOIN w), hk AS (SELECT -sum(k.n / w.n * ln(k.n / w.n)) AS h FROM k CROSS JOIN w) SELECT round(2 * mi / (hl.h + hk.h), 6) AS nmi, round(mi / hl.h, 6) AS homogeneity, round(mi / hk.h, 6) AS completeness FROM m CROSS JOIN hl CROSS JOIN hk",
    "v03_link_auc": f"""WITH {KNN}, g AS (SELECT round(d, 5) AS d, cast(floor(round(d, 5) * 20) AS BIGINT) AS cell, sum(CASE WHEN ql = bl THEN 1.0 ELSE 0.0 END) AS p, sum(CASE WHEN ql = bl THEN 0.0 ELSE 1.0 END) AS q FROM d GROUP BY 1, 2), gc AS (SELECT cell, sum(q) AS q FROM g GROUP BY cell), gb AS (SELECT cell, sum(q) OVER (ORDER BY cell DESC) - q AS above FROM gc),
a AS (SELECT p, g.q, gb.above + sum(g.q) OVER (PARTITION BY g.cell ORDER BY d DESC) - g.q / 2.0 AS above FROM g JOIN gb ON gb.cell = g.cell) SELECT round(sum(p * above) / (sum(p) * sum(q)), 6) AS auc FROM a""",
    "v04_k_precision": f"WITH {KNN} SELECT ql AS label, round(avg(p), 6) AS k_precision FROM (SELECT q, ql, avg(CASE WHEN ql = bl THEN 1.0 ELSE 0.0 END) AS p FROM r WHERE k <= 5 GROUP BY q, ql) t GROUP BY ql",
    "v05_k_precision_grid": f"WITH {KNN}, g AS (SELECT 5 AS top UNION ALL SELECT 10 UNION ALL SELECT 25 UNION ALL SELECT 50 UNION ALL SELECT 100) SELECT top, round(avg(CASE WHEN ql = bl THEN 1.0 ELSE 0.0 END), 6) AS k_precision FROM r JOIN g ON r.k <= g.top GROUP BY top",
    "v08_knn_vote": f"WITH {KNN}, c AS (SELECT q, ql, bl, count(*) AS n FROM r WHERE k <= 3 GROUP BY q, ql, bl), b AS (SELECT q, ql, bl, row_number() OVER (PARTITION BY q ORDER BY n DESC, bl) AS k FROM c) SELECT q, ql AS label, bl AS predicted FROM b WHERE k = 1",
    "v08_ten_folds": f"WITH {KNN}, t AS (SELECT 0 AS turn UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4), fo AS (SELECT vec_id, turn, cast(floor(10 * @u(concat('fold:', turn, ':', vec_id))@) AS BIGINT) AS fold FROM embeddings CROSS JOIN t), o AS (SELECT r.q, ql, bl, f.turn, f.fold, row_number() OVER (PARTITION BY r.q, f.turn ORDER BY r.k) AS k FROM r JOIN fo f ON f.vec_id = r.q JOIN fo g ON g.vec_id = r.b AND g.turn = f.turn WHERE g.fold <> f.fold), c AS (SELECT turn, fold, q, ql, bl, count(*) AS n FROM o WHERE k <= 3 GROUP BY turn, fold, q, ql, bl), b AS (SELECT turn, fold, CASE WHEN ql = bl THEN 1.0 ELSE 0.0 END AS hit, row_number() OVER (PARTITION BY turn, q ORDER BY n DESC, bl) AS k FROM c), s AS (SELECT turn, fold, avg(hit) AS hit FROM b WHERE k = 1 GROUP BY turn, fold) SELECT turn, count(*) AS folds, round(avg(hit), 6) AS accuracy, round(stddev_samp(hit), 6) AS deviation FROM s GROUP BY turn",
    "v10_density": f"WITH {X}, o AS (SELECT k, avg(x) AS m FROM x GROUP BY k), wi AS (SELECT sum((x.x - c.m) * (x.x - c.m)) AS s FROM x JOIN c ON c.label = x.label AND c.k = x.k), be AS (SELECT sum((c.m - o.m) * (c.m - o.m)) AS s FROM x JOIN c ON c.label = x.label AND c.k = x.k JOIN o ON o.k = x.k), z AS (SELECT count(*) AS n, count(DISTINCT label) AS g FROM embeddings) SELECT round(wi.s / (z.n - z.g), 4) AS within, round(be.s / (z.g - 1), 4) AS between_groups, round((be.s / (z.g - 1)) / (wi.s / (z.n - z.g)), 4) AS f, z.g - 1 AS free_between, z.n - z.g AS free_within FROM wi CROSS JOIN be CROSS JOIN z",
    "v11_purity": f"WITH {KNN} SELECT q, k, round(avg(CASE WHEN ql = bl THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY q ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS purity FROM r WHERE k <= 20",
    "v14_squared_error": f"WITH {X} SELECT x.label, round(avg((x.x - c.m) * (x.x - c.m)), 6) AS mse FROM x JOIN c ON c.label = x.label AND c.k = x.k GROUP BY x.label",
    "e08_sign_sketch": f"WITH {X}, b AS (SELECT 0 AS bit UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) SELECT vec_id, bit, (sign(y) * least(floor(abs(y)), 1) + 1) / 2.0 AS value FROM (SELECT vec_id, bit, sum(CASE WHEN @u(concat('bit:', bit, ':', k))@ < 0.5 THEN -x ELSE x END) AS y FROM x CROSS JOIN b GROUP BY vec_id, bit) t",
}
RANKS = {"v11_purity": "k"}
TURNS = 5


def ten_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of the three nearest vectors of other folds, among the few that can be these in any turn."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    fold = [F.floor(10 * F.conv(F.substring(F.md5(F.concat(F.lit(f"fold:{t}:"), F.col("vec_id").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0).cast("int") for t in range(TURNS)]
    near = nearest_of_other_folds(spark, v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.array(*fold).alias("folds")), v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id")), 3)
    view = f"near_{uuid.uuid4().hex[:12]}"
    near.join(v.select(F.col("vec_id").alias("q"), F.col("label").alias("ql")), "q").join(v.select(F.col("vec_id").alias("b"), F.col("label").alias("bl")), "b").createOrReplaceTempView(view)
    return query(SQL["v08_ten_folds"].replace(KNN, f"r AS (SELECT q, ql, b, bl, row_number() OVER (PARTITION BY q ORDER BY round(d, 5), b) AS k FROM {view})"))(spark, sf_dir)


QUERIES = {k: query(v, RANKS.get(k)) for k, v in SQL.items()} | {"v08_ten_folds": ten_folds}
ORACLES = {k: oracle(v) for k, v in SQL.items()}
