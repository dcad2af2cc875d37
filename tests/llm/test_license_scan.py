"""The licence scan against every window of every text."""

import random
import re

from orbweave.llm import license_scan as scan

LONG = " ".join(f"z{i}" for i in range(80))
WRAPPED = "Licensed under the Apache\nLicense, Version 2.0."
SOME = {k: v for k, v in scan.TEMPLATES.items()} | {"mit-text": scan.TEXTS["mit-text"]}


def grams_of(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def dice(window, own):
    return 2 * len(set(window) & own) / (len(set(window)) + len(own))


def best_dice(text, own):
    """The best of all windows: every start, every end."""
    grams, best = grams_of(text), 0.0
    if 10 * len(own & set(grams)) < 4 * (len(own) + len(own & set(grams))):
        return 0.0
    for i in range(len(grams)):
        seen, c = set(), 0
        for g in grams[i:]:
            if g not in seen:
                seen.add(g)
                c += g in own
                best = max(best, 2 * c / (len(seen) + len(own)))
    return best


def check(spark, texts, templates, schema="doc_id long, text string"):
    got = {r.doc_id: r.notices for r in scan.matches(spark.createDataFrame(texts, schema).repartition(3), templates).collect()}
    assert len(got) == len(texts)
    found = 0
    for row in texts:
        want = {k: d for k, t in templates.items() if (d := best_dice(row[1], set(grams_of(t)))) >= 0.8}
        assert {n.license: n.dice for n in got[row[0]]} == want
        found += len(want)
        for n in got[row[0]]:
            own, window = set(grams_of(templates[n.license])), grams_of(row[1])[n.first : n.last]
            assert dice(window, own) == n.dice and len(own & set(window)) == n.shared
    return found


def test_notices(spark):
    texts = [
        (1, f"{LONG}\n{WRAPPED}\n{LONG}"),
        (2, f"{LONG} Copyright 2024 Foo. All rights reserved. {LONG}"),
        (3, "\n".join([LONG, WRAPPED] * 3)),
        (4, f"{LONG}\nReleased under the\nMIT License.\n{LONG}\nLicensed under CC BY-NC 4.0.\n{LONG}"),
        (5, f"{LONG} all reserved rights {LONG} under the license {LONG}"),
        (6, SOME["mit-text"].replace(" ", "\n") + "\n".join([LONG] * 9)),
        (7, scan.TEMPLATES["apache-2.0-header"].replace(" ", "\n") + f"\n{LONG}"),
        (8, "word\n" + "All rights\nreserved.\n" * 40),
        (9, LONG),
        (10, None),
        (11, ""),
        (12, "word"),
        (13, "All rights reserved worldwide."),
        (14, "Released under the MIT License by us."),
        (15, "\n".join([scan.TEMPLATES["gpl-3.0-notice"]] * 6)),
        (16, "RELEASED under the MIT licence."),
        (None, f"{LONG}\n{WRAPPED}"),
        (17, (LONG + "\n") * 400 + WRAPPED),
    ]
    assert check(spark, texts, SOME) > 10


def test_random_windows(spark):
    rng = random.Random(11)
    pool = ["released", "under", "the", "mit", "license", "x", "y"]
    texts = [" ".join(["q"] * 9 + [rng.choice(pool) + rng.choice([" ", "\n"]) for _ in range(14)] + ["q"] * 9) for _ in range(150)]
    texts += [" ".join(["q w e r t z u i o p"] + rng.sample(["released under the", "the mit", "mit license", "under the mit license", "released under"], 3)) for _ in range(60)]
    assert 5 < check(spark, list(enumerate(texts)), {"mit": scan.TEMPLATES["mit"], "twice": "the mit the mit license", "tie": "Released under the MIT license"}) < 3 * len(texts)


def test_bounds_keep_what_reaches_the_threshold():
    for size in range(1, 60):
        lo, hi = scan.bounds(size, 0.8)
        assert [n for n in range(1, 120) if 10 * min(n, size) >= 4 * (n + size)] == list(range(lo, hi + 1))


def test_markers_and_first_words_are_needed():
    rng = random.Random(3)
    for key in ("mit", "gpl-3.0-notice", "mit-text"):
        own = scan.bigrams(SOME[key])
        least = scan.bounds(len(own), 0.8)[0]
        some, (first, n) = scan.markers(own, least), scan.first_words(own, least)
        for _ in range(200):
            part = {w for g in rng.sample(own, least) for w in g.split()}
            assert part & some and len(part & set(first)) >= n


def test_empty_tables_repeats_and_other_columns(spark):
    assert scan.matches(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(5, WRAPPED, 1, "x", 9), (5, WRAPPED, 2, "x", 9), (5, "other text here", 3, None, None)]
    got = scan.matches(spark.createDataFrame(rows, "doc_id long, text string, rid long, license string, p int"), SOME).collect()
    assert sorted([n.license for n in r.notices] for r in got) == [[], ["apache-2.0"], ["apache-2.0"]]
