"""Reproducible random walks: every draw is a hash of the seed, the walk and the step, so that any engine repeats it."""

from __future__ import annotations

from orbweave.functions.dialect import graph, oracle, query, ranked

G = graph()
NB = "nb AS (SELECT adj.u, adj.v, row_number() OVER (PARTITION BY adj.u ORDER BY adj.v) - 1 AS i, n.deg FROM adj JOIN n ON n.id = adj.u)"


def first_order(steps: int) -> str:
    out = [NB, "s0 AS (SELECT id AS walk, id AS c0 FROM n)"]
    for k in range(1, steps + 1):
        cols = ", ".join(f"s.c{j}" for j in range(k))
        out.append(f"s{k} AS (SELECT s.walk, {cols}, nb.v AS c{k} FROM s{k - 1} s JOIN nb ON nb.u = s.c{k - 1} AND nb.i = cast(floor(@u(concat('walk:', s.walk, ':{k}'))@ * nb.deg) AS BIGINT))")
    return ", ".join(out)


W5 = first_order(5)
LONG = "pos AS (" + " UNION ALL ".join(f"SELECT walk, {k} AS k, c{k} AS node FROM s5" for k in range(6)) + ")"
BIASED = f"{first_order(1)}, x AS (SELECT s.walk, s.c0, s.c1, nb.v, CASE WHEN nb.v = s.c0 THEN 0.25 WHEN c.u IS NOT NULL THEN 1.0 ELSE 4.0 END AS w FROM s1 s JOIN nb ON nb.u = s.c1 LEFT JOIN adj c ON c.u = s.c0 AND c.v = nb.v), y AS (SELECT walk, c0, c1, v, sum(w) OVER (PARTITION BY walk ORDER BY v) AS upto, sum(w) OVER (PARTITION BY walk) AS total FROM x)"


def second_order(steps: int) -> str:
    """z2 .. z{steps}: walks whose next node weighs 1/4 where it is the one before, 1 where it is next to that, 4 otherwise."""
    out = [first_order(1), "z1 AS (SELECT walk, c0, c1 FROM s1)"]
    for k in range(2, steps + 1):
        cols = ", ".join(f"c{j}" for j in range(k))
        out.append(f"x{k} AS (SELECT s.*, nb.v, CASE WHEN nb.v = s.c{k - 2} THEN 0.25 WHEN c.u IS NOT NULL THEN 1.0 ELSE 4.0 END AS w FROM z{k - 1} s JOIN nb ON nb.u = s.c{k - 1} LEFT JOIN adj c ON c.u = s.c{k - 2} AND c.v = nb.v)")
        out.append(f"y{k} AS (SELECT walk, {cols}, v, sum(w) OVER (PARTITION BY walk ORDER BY v) AS upto, sum(w) OVER (PARTITION BY walk) AS total FROM x{k})")
        out.append(f"z{k} AS (SELECT walk, {cols}, min(v) AS c{k} FROM y{k} WHERE upto >= @u(concat('second:', walk, ':{k}'))@ * total GROUP BY walk, {cols})")
    return ", ".join(out)


#: sub(id, kind): the anonymous form of every run of four nodes in a walk, which is itself a walk from its first node.
KINDS = "sub AS (" + " UNION ALL ".join(f"SELECT c{k} AS id, CASE WHEN c{k + 2} = c{k} THEN (CASE WHEN c{k + 3} = c{k + 1} THEN '0101' ELSE '0102' END) WHEN c{k + 3} = c{k} THEN '0120' WHEN c{k + 3} = c{k + 1} THEN '0121' ELSE '0123' END AS kind FROM s5" for k in range(3)) + ")"
TIMED = "a AS (SELECT user_id, event_type, event_id, ts, @epoch(ts)@ AS t FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM a)"
SQL = {
    "w01_first_order_walks": f"{G}, {W5} SELECT walk, c0, c1, c2, c3, c4, c5 FROM s5",
    "w02_second_order_walks": f"{G}, {second_order(10)} SELECT * FROM z10",
    "w03_inverse_cdf": f"{G}, {BIASED} SELECT walk, v, round(upto / total, 6) AS upto FROM y",
    "w04_rooted_step": f"{G}, {first_order(2)} SELECT walk, c0, c1, CASE WHEN @u(concat('root:', walk))@ < 0.5 THEN c2 ELSE c0 END AS c2 FROM s2",
    "w06_walk_batch": f"{G}, h AS (SELECT id, k, md5(concat(k, ':', id)) AS h, substr(md5(concat(k, ':', id)), 1, 3) AS cell FROM n CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) t), {ranked('h', 'k, cell', 'x.h, x.id')}, m AS (SELECT k, min(before) AS m FROM cb GROUP BY k) SELECT id, rk.k, cast(r - m AS BIGINT) AS turn FROM rk JOIN m ON m.k = rk.k",
    "w07_walk_contexts": f"{G}, {W5}, {LONG} SELECT a.node, b.k - a.k AS hop, b.node AS context, count(*) AS n FROM pos a JOIN pos b ON b.walk = a.walk AND b.k > a.k AND b.k <= a.k + 3 GROUP BY 1, 2, 3",
    "w08_temporal_walk_step": f"WITH {TIMED} SELECT x.event_id, y.event_id AS following, y.event_type FROM f x JOIN f y ON y.user_id = x.user_id AND y.r = x.r + 1",
    "w09_edge_starts": f"WITH {TIMED}, m AS (SELECT max(t) AS hi, min(t) AS lo FROM f), p AS (SELECT event_id, 'early' AS side FROM f CROSS JOIN m WHERE t <= lo + 0.1 * (hi - lo) UNION ALL SELECT event_id, 'late' FROM f CROSS JOIN m WHERE t >= lo + 0.9 * (hi - lo)) SELECT event_id, side FROM p WHERE @u(concat(side, ':', event_id))@ < 0.25",
    "w11_anonymous_walks": f"{G}, {W5}, {LONG}, fst AS (SELECT walk, node, min(k) AS k0 FROM pos GROUP BY walk, node), rk AS (SELECT walk, node, row_number() OVER (PARTITION BY walk ORDER BY k0) - 1 AS a FROM fst) SELECT pos.walk, pos.k, rk.a FROM pos JOIN rk ON rk.walk = pos.walk AND rk.node = pos.node",
    "w13_walk_type_scores": f"{G}, {W5}, {KINDS}, ct AS (SELECT id, kind, count(*) AS c FROM sub GROUP BY id, kind), tt AS (SELECT id, sum(c) AS t FROM ct GROUP BY id), ks AS (SELECT DISTINCT kind FROM ct), pk AS (SELECT tt.id, ks.kind, coalesce(c, 0) / cast(t AS DOUBLE) AS p FROM tt CROSS JOIN ks LEFT JOIN ct ON ct.id = tt.id AND ct.kind = ks.kind), mk AS (SELECT kind, avg(p) AS m, stddev_pop(p) AS s FROM pk GROUP BY kind) SELECT id, pk.kind, round((p - m) / (CASE WHEN s > 0 THEN s ELSE 0.001 END) + 1e-9, 5) AS z FROM pk JOIN mk ON mk.kind = pk.kind",
    "w14_walk_radius": f"{G}, {W5}, {LONG} SELECT walk, cast(floor(2 * 6 / cast(count(DISTINCT node) AS DOUBLE)) AS BIGINT) AS radius FROM pos GROUP BY walk",
    "w15_negative_samples": f"""{G}, o1 AS (SELECT id, cast(floor(id / 4096.0) AS BIGINT) AS cell, ceil(power(deg, 0.75)) AS w FROM n), o2 AS (SELECT cell, sum(w) AS s FROM o1 GROUP BY cell), o3 AS (SELECT cell, sum(s) OVER (ORDER BY cell) - s AS before, sum(s) OVER () AS total FROM o2),
mw AS (SELECT max(w) AS mw FROM o1), o AS (SELECT o1.id, o1.w, o3.before + sum(w) OVER (PARTITION BY o1.cell ORDER BY o1.id) AS upto FROM o1 JOIN o3 ON o3.cell = o1.cell),
c AS (SELECT o.id, w, upto, cast(floor((upto - w) / mw) AS BIGINT) + t AS t FROM o CROSS JOIN mw CROSS JOIN (SELECT 0 AS t UNION ALL SELECT 1) s),
x AS (SELECT id AS i, @u(concat('neg:', id))@ * total AS x, mw FROM n CROSS JOIN (SELECT max(total) AS total FROM o3) t CROSS JOIN mw)
SELECT x.i, c.id AS neg FROM x JOIN c ON c.t = cast(floor(x.x / x.mw) AS BIGINT) AND c.upto > x.x AND c.upto - c.w <= x.x LEFT JOIN adj ON adj.u = x.i AND adj.v = c.id WHERE adj.u IS NULL""",
    "w17_fixed_size_neighbours": f"{G}, {NB} SELECT n.id, k.k, nb.v FROM n CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k JOIN nb ON nb.u = n.id AND nb.i = cast(floor(@u(concat('fix:', n.id, ':', k.k))@ * n.deg) AS BIGINT)",
    "w19_cooccurrence": f"{G}, {W5}, {LONG} SELECT least(a.node, b.node) AS x, greatest(a.node, b.node) AS y, count(*) AS n FROM pos a JOIN pos b ON b.walk = a.walk AND b.k > a.k AND b.k <= a.k + 5 GROUP BY 1, 2",
    "f22_edge_visits": f"{G}, {W5}, v AS (" + " UNION ALL ".join(f"SELECT c0 AS id, least(c{k}, c{k + 1}) AS x, greatest(c{k}, c{k + 1}) AS y FROM s5" for k in range(5)) + ") SELECT id, x, y, count(*) AS visits FROM v GROUP BY id, x, y",
}
RANKS = {"w11_anonymous_walks": "a"}
QUERIES = {k: query(v, RANKS.get(k)) for k, v in SQL.items()}
ORACLES = {k: oracle(v) for k, v in SQL.items()}
