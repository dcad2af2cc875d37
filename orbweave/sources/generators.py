"""Synthetic graphs as SQL over ranges of ids: every edge is a function of its number, so that no step is sequential."""

from __future__ import annotations

from orbweave.functions.dialect import oracle, query

#: Shapes as (nodes, edges (a, b) as functions of id i, condition on i, role of node i) for a size n.
SHAPES = {
    "cycle": ("i", "(i + 1) % {n}", "i < {n}", "0"),
    "string": ("i", "i + 1", "i < {n} - 1", "CASE WHEN i IN (0, {n} - 1) THEN 1 ELSE 0 END"),
    "star": ("0", "i", "i BETWEEN 1 AND {n} - 1", "least(i, 1)"),
    "tree": ("cast(floor((i - 1) / 2.0) AS BIGINT)", "i", "i BETWEEN 1 AND {n} - 1", "CASE WHEN i = 0 THEN 0 WHEN 2 * i + 1 < {n} THEN 1 ELSE 2 END"),
}
#: The edges and roles of the shapes of a constant size.
DIAMOND = ([(0, 1), (1, 2), (2, 3), (3, 0), (0, 4), (1, 4), (2, 4), (3, 4), (0, 5), (1, 5), (2, 5), (3, 5)], [0] * 6)
HOUSE = ([(0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (1, 3), (0, 4), (1, 4)], [0, 0, 1, 1, 2])
HOLLOW = (
    [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0)]
    + [(5, 6), (6, 7), (7, 8), (8, 9), (9, 10), (10, 11), (11, 12), (12, 13), (13, 14), (14, 5)]
    + [(0, 5), (1, 7), (2, 9), (3, 11), (4, 13), (0, 6), (1, 6), (1, 8), (2, 8), (2, 10), (3, 10), (3, 12), (4, 12), (4, 14), (0, 14)],
    [0] * 15,
)
#: The friendships of Zachary's karate club, members by the smaller neighbour, as far as there are any.
KARATE = {
    0: (1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 17, 19, 21, 31), 1: (2, 3, 7, 13, 17, 19, 21, 30), 2: (3, 7, 8, 9, 13, 27, 28, 32),
    3: (7, 12, 13), 4: (6, 10), 5: (6, 10, 16), 6: (16,), 8: (30, 32, 33), 9: (33,), 13: (33,), 14: (32, 33), 15: (32, 33),
    18: (32, 33), 19: (33,), 20: (32, 33), 22: (32, 33), 23: (25, 27, 29, 32, 33), 24: (25, 27, 31), 25: (31,), 26: (29, 33),
    27: (33,), 28: (31, 33), 29: (32, 33), 30: (32, 33), 31: (32, 33), 32: (33,),
}


def shape_edges(kind: str, n: int, start: int = 0) -> str:
    """SELECT src, dst of a shape whose ids begin at start."""
    a, b, where, _ = (p.format(n=n) for p in SHAPES[kind])
    return f"SELECT {a} + {start} AS src, {b} + {start} AS dst FROM (SELECT id AS i FROM @range({n})@) r WHERE {where}"


def shape_roles(kind: str, n: int, start: int = 0, first_role: int = 0) -> str:
    role = SHAPES[kind][3].format(n=n)
    return f"SELECT i + {start} AS id, cast({role} + {first_role} AS BIGINT) AS role FROM (SELECT id AS i FROM @range({n})@) r"


def fixed_edges(shape: tuple[list[tuple[int, int]], list[int]], start: int = 0) -> str:
    return " UNION ALL ".join(f"SELECT cast({a + start} AS BIGINT) AS src, cast({b + start} AS BIGINT) AS dst" for a, b in shape[0])


def fixed_roles(shape: tuple[list[tuple[int, int]], list[int]], start: int = 0) -> str:
    return " UNION ALL ".join(f"SELECT cast({i + start} AS BIGINT) AS id, cast({r} AS BIGINT) AS role" for i, r in enumerate(shape[1]))


def fan(branches: int, start: int = 0) -> str:
    """A star whose neighbouring branches are joined, but for the last branch."""
    chain = f"SELECT id + {start} AS src, id + {start + 1} AS dst FROM @range({branches - 1})@ WHERE id >= 1"
    return f"{shape_edges('star', branches + 1, start)} UNION ALL {chain}"


def fan_roles(branches: int, start: int = 0) -> str:
    """The hub is 0, a branch 1 and one more for each joined neighbour."""
    role = f"CASE WHEN id = 0 THEN 0 ELSE 1 + CASE WHEN id BETWEEN 2 AND {branches - 1} THEN 1 ELSE 0 END + CASE WHEN id <= {branches - 2} THEN 1 ELSE 0 END END"
    return f"SELECT id + {start} AS id, cast({role} AS BIGINT) AS role FROM @range({branches + 1})@"


def cavemen(cliques: int, size: int) -> str:
    """A ring of cliques of `size` nodes; the last node of each meets the first of the next."""
    inside = f"SELECT c.id * {size} + a.id AS src, c.id * {size} + b.id AS dst FROM @range({cliques})@ c CROSS JOIN @range({size})@ a JOIN @range({size})@ b ON b.id > a.id"
    ring = f"SELECT id * {size} + {size - 1} AS src, ((id + 1) % {cliques}) * {size} AS dst FROM @range({cliques})@"
    return f"{inside} UNION ALL {ring}"


def cavemen_roles(cliques: int, size: int) -> str:
    """1 for the nodes that meet another clique."""
    return f"SELECT id, cast(CASE WHEN id % {size} IN (0, {size - 1}) THEN 1 ELSE 0 END AS BIGINT) AS role FROM @range({cliques * size})@"


def mirrored_karate() -> str:
    """Two copies of the club of 34 members and one edge between them."""
    own = [(a, b) for a, later in KARATE.items() for b in later]
    return fixed_edges((own + [(a + 34, b + 34) for a, b in own] + [(0, 36)], []))


def clique(n: int, start: int = 0, dropped: int = 0) -> str:
    """All pairs of n nodes but the first `dropped` of them by hash."""
    pairs = f"SELECT a.id + {start} AS src, b.id + {start} AS dst, row_number() OVER (ORDER BY md5(concat('clique:', a.id, ':', b.id)), a.id, b.id) AS k FROM @range({n})@ a JOIN @range({n})@ b ON b.id > a.id"
    return f"SELECT src, dst FROM ({pairs}) c WHERE k > {dropped}"


def barbell(n1: int, n2: int) -> str:
    """Two cliques of n1 nodes joined by a path of n2 nodes."""
    path = f"SELECT id + {n1 - 1} AS src, id + {n1} AS dst FROM @range({n2 + 1})@"
    return f"{clique(n1)} UNION ALL {path} UNION ALL {clique(n1, n1 + n2)}"


def erdos_renyi(n: int, p: float) -> str:
    return f"SELECT a.id AS src, b.id AS dst FROM @range({n})@ a JOIN @range({n})@ b ON b.id > a.id WHERE @u(concat('er:', a.id, ':', b.id))@ < {p}"


def watts_strogatz(n: int, k: int, p: float) -> str:
    """Ring lattice of k / 2 neighbours a side; an edge's far end moves with probability p. Loops and repeats vanish."""
    moved = f"CASE WHEN @u(concat('ws:', a.id, ':', j.id))@ < {p} THEN cast(floor(@u(concat('to:', a.id, ':', j.id))@ * {n}) AS BIGINT) ELSE (a.id + j.id + 1) % {n} END"
    return f"SELECT DISTINCT least(s, t) AS src, greatest(s, t) AS dst FROM (SELECT a.id AS s, {moved} AS t FROM @range({n})@ a CROSS JOIN @range({k // 2})@ j) x WHERE s <> t"


def preferential(n: int, m: int) -> str:
    """Barabasi-Albert without a sequence: the end of edge e copies a uniform earlier slot; copied slots are followed by
    recursion to a slot that holds its own node (slot 2e is the source of edge e, slot 2e + 1 its target)."""
    slot = "cast(floor(@u(concat('ba:', id))@ * (2 * id + 1)) AS BIGINT)"
    return (
        f"WITH RECURSIVE d AS (SELECT id AS e, {slot} AS p FROM @range({n * m})@), c AS (SELECT e, p FROM d UNION ALL SELECT c.e, d.p FROM c JOIN d ON d.e = (c.p - 1) / 2 WHERE c.p % 2 = 1) "
        f"SELECT DISTINCT cast(floor(e / {m}.0) AS BIGINT) AS src, cast(floor(p / {2 * m}.0) AS BIGINT) AS dst FROM c WHERE p % 2 = 0 AND floor(e / {m}.0) <> floor(p / {2 * m}.0)"
    )


def random_regular(n: int, d: int, tries: int = 32) -> str:
    """d / 2 random cycles, and for an odd d one perfect matching of an even n: the first of `tries` draws in which no
    edge repeats, so that every node has d neighbours (for d = 3 a draw succeeds with probability 1 / e)."""
    order = f"o AS (SELECT t.id AS t, c.id AS c, a.id, row_number() OVER (PARTITION BY t.id, c.id ORDER BY md5(concat(t.id, ':', c.id, ':rr:', a.id)), a.id) - 1 AS r FROM @range({n})@ a CROSS JOIN @range({(d + 1) // 2})@ c CROSS JOIN @range({tries})@ t)"
    step = f"b.t = a.t AND a.c = b.c AND b.r = (a.r + 1) % {n}" + (f" AND (a.c < {d // 2} OR a.r % 2 = 0)" if d % 2 else "")
    drawn = f"x AS (SELECT a.t, least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst FROM o a JOIN o b ON {step})"
    simple = "y AS (SELECT t, src, dst, count(*) AS k FROM x GROUP BY t, src, dst), z AS (SELECT t FROM y GROUP BY t HAVING max(k) = 1)"
    return f"WITH {order}, {drawn}, {simple} SELECT src, dst FROM x WHERE t = (SELECT min(t) FROM z)"


def composed(width: int, shapes: list[str], size: int) -> str:
    """A cycle of `width` nodes with shapes of `size` nodes attached at equal distances by one edge each."""
    gap = max(1, width // max(1, len(shapes)))
    parts = [shape_edges("cycle", width)]
    for k, s in enumerate(shapes):
        start = width + k * size
        parts += [shape_edges(s, size, start), f"SELECT cast({k * gap} AS BIGINT) AS src, cast({start} AS BIGINT) AS dst"]
    return " UNION ALL ".join(parts)


def composed_roles(width: int, shapes: list[str], size: int) -> str:
    return " UNION ALL ".join([shape_roles("cycle", width)] + [shape_roles(s, size, width + k * size, 10 * (k + 1)) for k, s in enumerate(shapes)])


def bricks(shapes: list[str], size: int, backbone: int = 30) -> str:
    """A small-world backbone with shapes at nodes chosen by hash."""
    parts = [watts_strogatz(backbone, 4, 0.3)]
    for k, s in enumerate(shapes):
        start = backbone + k * size
        parts += [shape_edges(s, size, start), f"SELECT cast(floor(@u('brick:{k}')@ * {backbone}) AS BIGINT) AS src, cast({start} AS BIGINT) AS dst"]
    return " UNION ALL ".join(f"SELECT src, dst FROM ({p}) p{i}" for i, p in enumerate(parts))


SQL = {
    "g01_erdos_renyi": erdos_renyi(1000, 0.1),
    "g01_watts_strogatz": watts_strogatz(1000, 4, 0.5),
    "g01_preferential": preferential(1000, 3),
    "g01_random_regular": random_regular(1000, 3),
    "g02_barbell": barbell(10, 5),
    "g02_cycle": shape_edges("cycle", 20),
    "g02_string": shape_edges("string", 20),
    "g02_star": shape_edges("star", 20),
    "g02_tree": shape_edges("tree", 31),
    "g02_clique": clique(12, dropped=4),
    "g02_diamond": fixed_edges(DIAMOND),
    "g02_house": fixed_edges(HOUSE),
    "g02_star_roles": shape_roles("star", 20),
    "g02_string_roles": shape_roles("string", 20),
    "g02_tree_roles": shape_roles("tree", 31),
    "g02_house_roles": fixed_roles(HOUSE),
    "g02_fan": fan(20),
    "g02_fan_roles": fan_roles(20),
    "g02_hollow": fixed_edges(HOLLOW),
    "g02_cavemen": cavemen(6, 5),
    "g02_cavemen_roles": cavemen_roles(6, 5),
    "g02_mirrored_karate": mirrored_karate(),
    "g02_mirrored_karate_roles": "SELECT id, id % 34 AS role FROM @range(68)@",
    "g03_structure_edges": composed(24, ["star", "tree", "string"], 7),
    "g03_structure_roles": composed_roles(24, ["star", "tree", "string"], 7),
    "g04_bricks": bricks(["star", "cycle", "tree"], 7),
    "g05_small_world": watts_strogatz(500, 6, 0.1),
}
QUERIES = {k: query(v) for k, v in SQL.items()}
ORACLES = {k: oracle(v) for k, v in SQL.items()}
