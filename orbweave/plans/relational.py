"""Relational operators on graphs, labels and vectors: filters, joins, aggregates, ranks, bins and samples."""

from __future__ import annotations

from orbweave.functions.dialect import graph, oracle, query, ranked

G = graph()
EVENTS = "SELECT event_type, value FROM events WHERE value IS NOT NULL"
SQL = {
    "r01_drop_self_loops": "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey",
    "r02_dedup_undirected": "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "r03_symmetrise": f"{G} SELECT u, v FROM adj",
    "r04_project": "SELECT vec_id, label FROM embeddings",
    "r05_gather_labelled": f"{G} SELECT n.id, n.deg, p.p_size AS label FROM n JOIN part p ON p.p_partkey = n.id",
    "r06_neighbours_of_neighbours": f"{G} SELECT a.u, b.v AS w, count(*) AS paths FROM adj a JOIN adj b ON a.v = b.u WHERE a.u <> b.v GROUP BY a.u, b.v",
    "r08_next_edges_after": "WITH d AS (SELECT user_id, ts, count(*) AS c FROM events GROUP BY user_id, ts), w AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS following, cast(sum(c) OVER (PARTITION BY user_id ORDER BY ts DESC) - c AS BIGINT) AS n FROM d) SELECT a.event_id, w.following, w.n FROM events a JOIN w ON w.user_id = a.user_id AND w.ts = a.ts",
    "r09_semi_join": f"{G} SELECT id FROM n WHERE EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = n.id AND p.p_size = 1)",
    "r10_anti_join": f"{G} SELECT p_partkey AS id FROM part p WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = p.p_partkey)",
    "r11_left_join_default": f"{G} SELECT p_partkey AS id, coalesce(n.deg, 0) AS deg FROM part LEFT JOIN n ON n.id = p_partkey",
    "r12_neighbour_sum_mean": f"{G} SELECT adj.u AS id, cast(sum(n.deg) AS BIGINT) AS total, round(avg(n.deg), 6) AS mean FROM adj JOIN n ON n.id = adj.v GROUP BY adj.u",
    "r13_degree_frequency": f"{G} SELECT deg, count(*) AS n FROM n GROUP BY deg",
    "r14_nine_statistics": f"""{G}, x AS (SELECT adj.u, cast(n.deg AS DOUBLE) AS d FROM adj JOIN n ON n.id = adj.v), m AS (SELECT u, avg(d) AS mu FROM x GROUP BY u)
SELECT x.u AS id, min(d) AS least, max(d) AS most, round(avg(d), 6) AS mean, round(sqrt(avg((d - mu) * (d - mu))), 6) AS sd, round(avg((d - mu) * (d - mu)), 6) AS variance,
 round(percentile_cont(0.25) WITHIN GROUP (ORDER BY d), 6) AS p25, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY d), 6) AS p50,
 round(avg(power(d - mu, 3)) / nullif(power(avg((d - mu) * (d - mu)), 1.5), 0), 4) AS skew, round(avg(power(d - mu, 4)) / nullif(power(avg((d - mu) * (d - mu)), 2), 0) - 3, 4) AS kurt
FROM x JOIN m ON m.u = x.u GROUP BY x.u""",
    "r15_distinct_count": "SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id",
    "r16_range_scale": f"{G}, r AS (SELECT max(deg) AS hi, min(deg) AS lo FROM n) SELECT id, round((deg - lo) / nullif(cast(hi - lo AS DOUBLE), 0), 6) AS x FROM n CROSS JOIN r",
    "r17_normalise": f"{G}, x AS (SELECT adj.u, adj.v, cast(n.deg AS DOUBLE) AS w FROM adj JOIN n ON n.id = adj.v) SELECT u, v, round(w / sum(w) OVER (PARTITION BY u), 5) AS l1, round(w / max(w) OVER (PARTITION BY u), 5) AS by_max, round(w / sqrt(sum(w * w) OVER (PARTITION BY u)) + 1e-9, 5) AS l2 FROM x",
    "r18_neighbours_by_degree": f"{G} SELECT adj.u, adj.v, row_number() OVER (PARTITION BY adj.u ORDER BY n.deg, adj.v) AS pos FROM adj JOIN n ON n.id = adj.v",
    "r19_top_k_per_group": "SELECT user_id, event_id, k FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS k FROM events) t WHERE k <= 5",
    "r20_top_and_bottom_k": f"{G}, x AS (SELECT adj.u, adj.v, n.deg FROM adj JOIN n ON n.id = adj.v), r AS (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY deg DESC, v) AS hi, row_number() OVER (PARTITION BY u ORDER BY deg, v) AS lo FROM x) SELECT u, v, hi <= 3 AS top, lo <= 3 AS bottom FROM r WHERE hi <= 3 OR lo <= 3",
    "r21_degree_before_after": f"{G}, d AS (SELECT DISTINCT deg FROM n) SELECT deg, lag(deg) OVER (ORDER BY deg) AS before, lead(deg) OVER (ORDER BY deg) AS after FROM d",
    "r22_quantile_bins": f"{G}, q AS (SELECT percentile_cont(0.25) WITHIN GROUP (ORDER BY deg) AS a, percentile_cont(0.5) WITHIN GROUP (ORDER BY deg) AS b, percentile_cont(0.75) WITHIN GROUP (ORDER BY deg) AS c FROM n) SELECT id, CASE WHEN deg <= a THEN 0 WHEN deg <= b THEN 1 WHEN deg <= c THEN 2 ELSE 3 END AS bin FROM n CROSS JOIN q",
    "r23_one_hot": f"{G} SELECT id, CASE WHEN deg < 10 THEN 1 ELSE 0 END AS b0, CASE WHEN deg >= 10 AND deg < 20 THEN 1 ELSE 0 END AS b1, CASE WHEN deg >= 20 AND deg < 40 THEN 1 ELSE 0 END AS b2, CASE WHEN deg >= 40 THEN 1 ELSE 0 END AS b3 FROM n",
    "r24_histograms": f"{G}, x AS (SELECT id, cast(floor(ln(deg) / ln(2)) AS BIGINT) AS log_bin, cast(floor(deg / 5.0) AS BIGINT) AS bin FROM n) SELECT log_bin, bin, count(*) AS n FROM x GROUP BY 1, 2",
    "r25_exact_split": f"WITH h AS (SELECT vec_id, md5(concat('s', vec_id)) AS h, substr(md5(concat('s', vec_id)), 1, 3) AS cell FROM embeddings), {ranked('h', 'cell', 'x.h, x.vec_id')} SELECT vec_id, r <= floor(0.7 * total) AS train FROM rk",
    "r26_weighted_sample": f"{G}, x AS (SELECT adj.u, adj.v, n.deg, -ln(@u(concat('w', adj.u, ':', adj.v))@ + 1e-12) / (n.deg + 0.01) AS key FROM adj JOIN n ON n.id = adj.v), r AS (SELECT u, v, deg, row_number() OVER (PARTITION BY u ORDER BY key, v) AS k FROM x) SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY deg, v) AS pos FROM r WHERE k <= 10",
    "w20_degree_sequences": f"{G}, x AS (SELECT adj.u, adj.v, n.deg, -ln(@u(concat('w', adj.u, ':', adj.v))@ + 1e-12) / (n.deg + 0.01) AS key FROM adj JOIN n ON n.id = adj.v), r AS (SELECT u, v, deg, row_number() OVER (PARTITION BY u ORDER BY key, v) AS k FROM x), sq AS (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY deg, v) AS pos FROM r WHERE k <= 10) SELECT n.id, p.id + 1 AS pos, coalesce(sq.v + 1, 0) AS token FROM n CROSS JOIN @range(10)@ p LEFT JOIN sq ON sq.u = n.id AND sq.pos = p.id + 1",
    "r27_uniform_neighbours": f"{G}, r AS (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY md5(concat('u', u, ':', v)), v) AS k FROM adj) SELECT u, v, k FROM r WHERE k < 50 UNION ALL SELECT id, id, 0 FROM n",
    "r28_mean_and_deviation": f"SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM ({EVENTS}) t GROUP BY event_type",
    "r29_correlation": f"{G}, x AS (SELECT adj.u, cast(max(a.deg) AS DOUBLE) AS d, cast(sum(b.deg) AS DOUBLE) AS s, avg(b.deg) AS m FROM adj JOIN n a ON a.id = adj.u JOIN n b ON b.id = adj.v GROUP BY adj.u) SELECT round(corr(d, s), 6) AS ds, round(corr(d, m), 6) AS dm, round(corr(s, m), 6) AS sm FROM x",
    "r31_jaccard": f"{G}, c AS (SELECT a.v AS x, b.v AS y, count(*) AS c FROM adj a JOIN adj b ON a.u = b.u WHERE a.v < b.v GROUP BY a.v, b.v) SELECT x, y, c, round(c / cast(p.deg + q.deg - c AS DOUBLE), 6) AS j FROM c JOIN n p ON p.id = x JOIN n q ON q.id = y",
    "r33_induced_subgraph": f"{G}, s AS (SELECT id FROM n WHERE deg >= 20) SELECT e.src, e.dst FROM e JOIN s a ON a.id = e.src JOIN s b ON b.id = e.dst",
    "s18_dense_ids": f"{G}, q AS (SELECT id, cast(floor(id / 4096.0) AS BIGINT) AS cell FROM n), {ranked('q', 'cell', 'x.id')} SELECT id, r - 1 AS new_id FROM rk",
    "r07_theta_join": f"{G}, d AS (SELECT deg, count(*) AS c FROM n GROUP BY deg) SELECT a.deg AS lower, b.deg AS higher, CASE WHEN a.deg = b.deg THEN a.c * (a.c - 1) / 2.0 ELSE a.c * b.c * 1.0 END AS pairs FROM d a JOIN d b ON b.deg >= a.deg",
    "r24_fixed_bins": f"{G}, m AS (SELECT max(deg) AS m FROM n), x AS (SELECT id, deg / cast(m AS DOUBLE) AS x FROM n CROSS JOIN m), b AS (SELECT least(cast(floor(x * 20) AS BIGINT), 19) AS bin, count(*) AS c FROM x GROUP BY 1), t AS (SELECT sum(c) AS t FROM b) SELECT bin, c, round(-(c / cast(t AS DOUBLE)) * ln(c / cast(t AS DOUBLE)), 6) AS entropy_part FROM b CROSS JOIN t",
    "r30_concatenated_rounds": f"{G}, a AS (SELECT adj.u AS id, cast(sum(n.deg) AS BIGINT) AS s FROM adj JOIN n ON n.id = adj.v GROUP BY adj.u), b AS (SELECT adj.u AS id, cast(sum(a.s) AS BIGINT) AS s FROM adj JOIN a ON a.id = adj.v GROUP BY adj.u) SELECT n.id, n.deg, a.s AS round_1, b.s AS round_2 FROM n JOIN a ON a.id = n.id JOIN b ON b.id = n.id",
    "r32_prefixes": f"{G}, r AS (SELECT adj.u, adj.v, row_number() OVER (PARTITION BY adj.u ORDER BY n.deg DESC, adj.v) AS k FROM adj JOIN n ON n.id = adj.v) SELECT u, v, k FROM r WHERE k <= 10",
    "s07_temporal_bounds": "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY user_id",
    "w10_temporal_neighbours": "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events",
}
RANKS = {"r18_neighbours_by_degree": "pos", "r19_top_k_per_group": "k", "r26_weighted_sample": "pos", "r27_uniform_neighbours": "k", "r32_prefixes": "k", "w10_temporal_neighbours": "pos"}
QUERIES = {k: query(v, RANKS.get(k)) for k, v in SQL.items()}
ORACLES = {k: oracle(v) for k, v in SQL.items()}
