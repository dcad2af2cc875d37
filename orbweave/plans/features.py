"""Structural features of nodes: egonets, recursion, motifs, labels of neighbourhoods, layers and centralities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbweave.functions.dialect import graph, oracle, query

G = graph()
#: Triangles once each, by the order of ids; tri(id, t) counts them at each corner.
TRI = "t3 AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = a.src AND c.dst = b.dst), tri AS (SELECT id, count(*) AS t FROM (SELECT x AS id FROM t3 UNION ALL SELECT y AS id FROM t3 UNION ALL SELECT z AS id FROM t3) c GROUP BY id)"
EGO = f"{TRI}, s AS (SELECT adj.u, cast(sum(b.deg) AS BIGINT) AS sd FROM adj JOIN n b ON b.id = adj.v GROUP BY adj.u), ego AS (SELECT n.id, n.deg, coalesce(t, 0) AS t, n.deg + coalesce(t, 0) AS inside, n.deg + sd AS overall FROM n LEFT JOIN tri ON tri.id = n.id JOIN s ON s.u = n.id)"
EGO_OUT = "SELECT id, deg, inside, overall, round(inside / cast(overall AS DOUBLE), 6) AS inside_ratio, round((overall - inside) / cast(overall AS DOUBLE), 6) AS outside_ratio, CASE WHEN deg < 2 THEN 0.0 ELSE round(2.0 * t / (deg * (deg - 1)), 6) END AS clustering FROM ego"
BINS = "percentile_cont(0.25) WITHIN GROUP (ORDER BY {0}) AS a, percentile_cont(0.5) WITHIN GROUP (ORDER BY {0}) AS b, percentile_cont(0.75) WITHIN GROUP (ORDER BY {0}) AS c, min({0}) AS lo, max({0}) AS hi"
REFEX = f"{EGO}, r1 AS (SELECT adj.u AS id, cast(sum(ego.inside) AS DOUBLE) AS s1, avg(ego.inside) AS m1, cast(sum(ego.deg) AS DOUBLE) AS s2, avg(ego.deg) AS m2 FROM adj JOIN ego ON ego.id = adj.v GROUP BY adj.u)"
WL0 = "w0 AS (SELECT id, cast(cast(floor(ln(deg + 1) / ln(1.5)) AS BIGINT) AS VARCHAR(20)) AS l FROM n)"


def wl(i: int) -> str:
    return f"w{i} AS (SELECT o.id, md5(concat(max(o.l), '_', @list(b.l)@)) AS l FROM w{i - 1} o JOIN adj ON adj.u = o.id JOIN w{i - 1} b ON b.id = adj.v GROUP BY o.id)"


BFS = "hop AS (SELECT id AS root, id AS node, 0 AS d FROM n UNION ALL SELECT u, v, 1 FROM adj UNION ALL SELECT DISTINCT a.u, b.v, 2 FROM adj a JOIN adj b ON b.u = a.v WHERE a.u <> b.v AND NOT EXISTS (SELECT 1 FROM adj c WHERE c.u = a.u AND c.v = b.v))"


def powers(k: int) -> str:
    """Power iteration from ones, without normalising: x0 .. xk."""
    return "x0 AS (SELECT id, cast(1 AS DOUBLE) AS x FROM n), " + ", ".join(f"x{i} AS (SELECT adj.u AS id, sum(x{i - 1}.x) AS x FROM adj JOIN x{i - 1} ON x{i - 1}.id = adj.v GROUP BY adj.u)" for i in range(1, k + 1))



def propagated() -> str:
    """Seven egonet features F, (A + I) F and D^-1 (A + I) F, each divided by the column's maximum."""
    cols = ("deg", "t", "inside", "overall", "inside_ratio", "outside_ratio", "clustering")
    base = "SELECT id, deg, t, inside, overall, inside / cast(overall AS DOUBLE) AS inside_ratio, (overall - inside) / cast(overall AS DOUBLE) AS outside_ratio, CASE WHEN deg < 2 THEN 0.0 ELSE 2.0 * t / (deg * (deg - 1)) END AS clustering FROM ego"
    sums = ", ".join(f"max(o.{c}) AS a_{c}, cast(max(o.{c}) + sum(b.{c}) AS DOUBLE) AS s_{c}, cast(max(o.{c}) + sum(b.{c}) AS DOUBLE) / max(o.deg) AS m_{c}" for c in cols)
    names = [f"{k}_{c}" for k in "asm" for c in cols]
    most = ", ".join(f"max({c}) AS x_{c}" for c in names)
    out = ", ".join(f"round(coalesce({c} / nullif(cast(x_{c} AS DOUBLE), 0), 0) + 1e-9, 5) AS {c}" for c in names)
    return f"{G}, {EGO}, fb AS ({base}), fs AS (SELECT o.id, {sums} FROM fb o JOIN adj ON adj.u = o.id JOIN fb b ON b.id = adj.v GROUP BY o.id), fm AS (SELECT {most} FROM fs) SELECT id, {out} FROM fs CROSS JOIN fm"


SQL = {
    "f01_degree": f"{G} SELECT id, deg FROM n",
    "f02_egonet_features": f"{G}, {EGO} {EGO_OUT}",
    "f03_egonet_triangles": f"{G}, {EGO} SELECT id, t, inside, overall, round(coalesce(overall / nullif(cast(inside AS DOUBLE), 0), 0), 6) AS ratio FROM ego",
    "f04_triangles": f"{G}, {TRI} SELECT n.id, coalesce(t, 0) AS triangles, CASE WHEN deg < 2 THEN 0.0 ELSE round(2.0 * coalesce(t, 0) / (deg * (deg - 1)), 6) END AS clustering FROM n LEFT JOIN tri ON tri.id = n.id",
    "f05_recursive_round": f"{G}, {REFEX} SELECT id, s1, round(m1, 6) AS m1, s2, round(m2, 6) AS m2 FROM r1",
    "f06_pruning_correlations": f"{G}, {REFEX} SELECT round(corr(ego.deg, s1), 6) AS deg_s1, round(corr(ego.deg, m1), 6) AS deg_m1, round(corr(ego.inside, s2), 6) AS inside_s2, round(corr(ego.inside, m2), 6) AS inside_m2 FROM r1 JOIN ego ON ego.id = r1.id",
    "f07_binarised": f"{G}, {REFEX}, q AS (SELECT {BINS.format('s1')} FROM r1) SELECT id, CASE WHEN s1 <= a THEN 1 ELSE 0 END AS b0, CASE WHEN s1 > a AND s1 <= b THEN 1 ELSE 0 END AS b1, CASE WHEN s1 > b AND s1 <= c THEN 1 ELSE 0 END AS b2, CASE WHEN s1 > c THEN 1 ELSE 0 END AS b3 FROM r1 CROSS JOIN q WHERE lo < a AND a < b AND b < c AND c < hi",
    "f08_propagated": propagated(),
    "f12_wl_labels": f"{G}, {WL0}, {wl(1)}, {wl(2)} SELECT w0.id, w0.l AS l0, w1.l AS l1, w2.l AS l2 FROM w0 JOIN w1 ON w1.id = w0.id JOIN w2 ON w2.id = w0.id",
    "f13_degree_label": f"{G} SELECT id, cast(deg AS VARCHAR(20)) AS label FROM n",
    "f14_layer_degrees": f"{G}, {BFS} SELECT root, d, count(*) AS size, cast(sum(deg) AS BIGINT) AS total, max(deg) AS most FROM hop JOIN n ON n.id = node GROUP BY root, d",
    "f15_compact_layers": f"{G}, {BFS} SELECT root, d, deg, count(*) AS freq FROM hop JOIN n ON n.id = node GROUP BY root, d, deg",
    "f16_egonets": f"{G}, h AS (SELECT id AS root, id AS node, 0 AS d FROM n UNION ALL SELECT u, v, 1 FROM adj) SELECT a.root, a.node AS x, b.node AS y, greatest(a.d, b.d) AS hop FROM h a JOIN e ON e.src = a.node JOIN h b ON b.root = a.root AND b.node = e.dst",
    "f18_branch_list": f"{G} SELECT adj.u AS id, round(sum(n.deg / cast(n.deg + 1 AS DOUBLE)), 6) AS leaf_mass, round(sum(1 / cast(n.deg + 1 AS DOUBLE)), 6) AS back_mass FROM adj JOIN n ON n.id = adj.v GROUP BY adj.u",
    "f19_sorted_neighbour_degrees": f"{G} SELECT adj.u AS id, count(*) AS deg, @list(lpad(cast(n.deg AS VARCHAR(20)), 10, '0'))@ AS degrees FROM adj JOIN n ON n.id = adj.v GROUP BY adj.u",
    "f23_closeness_two_hops": f"{G}, {BFS} SELECT root AS id, count(*) - 1 AS reached, round((count(*) - 1) / nullif(cast(sum(d) AS DOUBLE), 0), 6) AS closeness FROM hop GROUP BY root",
    "f23_eigenvector_power": f"{G}, {powers(4)}, m AS (SELECT sqrt(sum(x * x)) AS l FROM x4) SELECT id, round(x / l + 1e-9, 5) AS x FROM x4 CROSS JOIN m",
    "f24_vertex_similarity_two_terms": f"{G}, a2 AS (SELECT a.u, b.v, count(*) AS c FROM adj a JOIN adj b ON b.u = a.v GROUP BY a.u, b.v) SELECT a2.u, a2.v, round((0.25 * c + 0.5 * (CASE WHEN adj.u IS NULL THEN 0 ELSE 1 END)) / (p.deg * q.deg) + 1e-9, 5) AS s FROM a2 LEFT JOIN adj ON adj.u = a2.u AND adj.v = a2.v JOIN n p ON p.id = a2.u JOIN n q ON q.id = a2.v",
    "f28_degree_class": f"{G}, m AS (SELECT max(deg) AS hi FROM n) SELECT id, cast(floor(ln(deg) / ln(hi + 1) * 8) AS BIGINT) AS cls FROM n CROSS JOIN m",
    "n01_in_out_degrees": f"{G}, i AS (SELECT dst AS id, count(*) AS k FROM e GROUP BY dst), o AS (SELECT src AS id, count(*) AS k FROM e GROUP BY src) SELECT n.id, deg AS total, coalesce(i.k, 0) AS indegree, coalesce(o.k, 0) AS outdegree FROM n LEFT JOIN i ON i.id = n.id LEFT JOIN o ON o.id = n.id",
    "n02_bucket_count": f"{G} SELECT greatest(30, cast(floor(ln(max(deg)) / ln(2)) AS BIGINT) + 1) AS buckets FROM n",
    "n03_hop_histograms": f"{G}, {BFS} SELECT root, d, cast(floor(ln(deg) / ln(2)) AS BIGINT) AS bucket, count(*) AS freq FROM hop JOIN n ON n.id = node WHERE d > 0 GROUP BY 1, 2, 3",
}
QUERIES = {k: query(v) for k, v in SQL.items()}
ORACLES = {k: oracle(v) for k, v in SQL.items()}


def egonet_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["f02_egonet_features"](spark, sf_dir)
