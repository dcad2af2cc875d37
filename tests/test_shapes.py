"""Shapes against plain loops and known counts."""

from collections import Counter
from itertools import combinations

from orbweave.sources import generators


def edges(spark, name):
    got = [tuple(sorted((r["src"], r["dst"]))) for r in generators.QUERIES[name](spark, "").collect()]
    assert len(got) == len(set(got)) and all(a != b for a, b in got)
    return set(got)


def roles(spark, name):
    return [r["role"] for r in sorted(generators.QUERIES[name](spark, "").collect())]


def test_fan(spark):
    assert edges(spark, "g02_fan") == {(0, k) for k in range(1, 21)} | {(k, k + 1) for k in range(1, 19)}
    want = [0] + [1] * 20
    for k in range(1, 19):
        want[k] += 1
        want[k + 1] += 1
    assert roles(spark, "g02_fan_roles") == want


def test_roles_of_stars_strings_and_trees(spark):
    """Hub and branches; ends and what is between; root, inner nodes and leaves."""
    assert roles(spark, "g02_star_roles") == [0] + [1] * 19
    assert roles(spark, "g02_string_roles") == [1] + [0] * 18 + [1]
    assert roles(spark, "g02_tree_roles") == [0] + [1] * 14 + [2] * 16


def test_house_and_hollow(spark):
    house = edges(spark, "g02_house")
    degree = Counter(x for e in house for x in e)
    assert len(house) == 8 and [degree[i] for i in range(5)] == [4, 4, 3, 3, 2]
    assert roles(spark, "g02_house_roles") == [0, 0, 1, 1, 2]
    hollow = edges(spark, "g02_hollow")
    degree = Counter(x for e in hollow for x in e)
    # The inner ring has two edges of its ring and three to the outer one; the outer ring turns by one or two.
    assert len(hollow) == 30 and [degree[i] for i in range(5)] == [5] * 5 and [degree[i] for i in range(5, 15)] == [3, 4] * 5


def test_cavemen(spark):
    want = {(5 * c + a, 5 * c + b) for c in range(6) for a, b in combinations(range(5), 2)}
    want |= {tuple(sorted((5 * c + 4, 5 * (c + 1) % 30))) for c in range(6)}
    assert edges(spark, "g02_cavemen") == want
    assert roles(spark, "g02_cavemen_roles") == [1, 0, 0, 0, 1] * 6


def test_mirrored_karate(spark):
    """78 edges, 45 triangles and degrees to 17 in each club."""
    both = edges(spark, "g02_mirrored_karate")
    first = {e for e in both if max(e) < 34}
    assert both == first | {(a + 34, b + 34) for a, b in first} | {(0, 36)} and len(first) == 78
    degree = Counter(x for e in first for x in e)
    assert sorted(degree)[-1] == 33 and len(degree) == 34 and (degree[0], degree[33], degree[11]) == (16, 17, 1)
    assert sum({(a, b), (a, c), (b, c)} <= first for a, b, c in combinations(range(34), 3)) == 45
    assert roles(spark, "g02_mirrored_karate_roles") == list(range(34)) * 2
