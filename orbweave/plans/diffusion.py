"""Normalised operators, heat diffusion by Taylor terms of the normalised Laplacian, and characteristic functions."""

from __future__ import annotations

from orbweave.functions.dialect import graph, oracle, query

G = graph()
#: heat = (1 - s + s^2 / 2) I + (s - s^2) P + s^2 / 2 P P, the second-order Taylor form of exp(-s L), s = 0.5.
NORM = "p AS (SELECT adj.u, adj.v, 1 / sqrt(cast(a.deg AS DOUBLE) * b.deg) AS w FROM adj JOIN n a ON a.id = adj.u JOIN n b ON b.id = adj.v)"
HEAT = f"{NORM}, z AS (SELECT id AS i, id AS j, cast(0.625 AS DOUBLE) AS x FROM n UNION ALL SELECT u, v, 0.25 * w FROM p UNION ALL SELECT a.u, b.v, 0.125 * a.w * b.w FROM p a JOIN p b ON b.u = a.v), heat AS (SELECT i, j, sum(x) AS x FROM z GROUP BY i, j)"
SQL = {
    "h01_normalised_laplacian": f"{G}, {NORM} SELECT u, v, round(-w, 6) AS x FROM p UNION ALL SELECT id, id, cast(1 AS DOUBLE) FROM n",
    "h02_row_normalised": f"{G} SELECT adj.u, adj.v, round(1 / cast(n.deg AS DOUBLE), 6) AS w FROM adj JOIN n ON n.id = adj.u",
    "h05_scales": f"{G}, c AS (SELECT count(*) AS n FROM n) SELECT round(-ln(0.95) * sqrt(0.5 * n), 6) AS s_min, round(-ln(0.8) * sqrt(0.5 * n), 6) AS s_max FROM c",
}
QUERIES = {k: query(v) for k, v in SQL.items()}
ORACLES = {k: oracle(v) for k, v in SQL.items()}
