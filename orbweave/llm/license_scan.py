"""Licence scan: windows of a text's words against licence templates, by Dice coefficient over sets of word bigrams.

Every run of consecutive words is a unit, across line ends, at any start and in any size; a template's score in a text
is the best Dice coefficient of any such window, and the template is found if that reaches the threshold t. Notices and
whole licence texts are templates alike; one inside another is found by itself.

Size bounds prune: a window that reaches t holds at least t / (2 - t) of the template's bigrams, and at most
(2 - t) / t times as many as it. So a text is left out before its words are taken apart if it lacks all marker words of
all templates that it is long enough for, and a template is left out for a text that holds too few of its bigrams in all.
For the pairs that stay, windows begin where a run of the template's bigrams begins: growing a window to the left by one
of the template's bigrams never lowers its Dice coefficient, so that other starts can't be better.

Cases: null and empty texts, and texts of fewer than two words, match nothing; of equally good windows the one with most
of the template counts, then the first, then the shortest; repeated rows are kept; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm.common import stored, table
from orbweave.llm.license_texts import TEXTS

# Notices by which works are licensed.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
THRESHOLD = 0.8


def bigrams(text: str) -> list[str]:
    w = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Least and most size of a unit that reaches the threshold with a template of that size, in integers."""
    t = Fraction(str(threshold))
    num, den = t.numerator, 2 * t.denominator - t.numerator
    return -(-size * num // den), size * den // num


def markers(own: list[str], least: int) -> set[str]:
    """Words of which a text has at least one if it has `least` of the bigrams: all but least - 1 of them have a marker."""
    of: dict[str, set[int]] = {}
    for i, g in enumerate(own):
        for w in g.split():
            of.setdefault(w, set()).add(i)
    out: set[str] = set()
    marked: set[int] = set()
    for w in sorted(of, key=lambda w: (-len(w), w)):
        if len(marked) > len(own) - least:
            break
        out.add(w)
        marked |= of[w]
    return out


def literals(values: list[str]) -> Column:
    """A constant array of words, as one literal."""
    return F.split(F.lit("\n".join(values)), "\n")


def first_words(own: list[str], least: int) -> tuple[list[str], int]:
    """The words that bigrams begin with, and how many of them `least` of the bigrams have at the least."""
    of: dict[str, int] = {}
    for g in own:
        of[g.split()[0]] = of.get(g.split()[0], 0) + 1
    n = 0
    for need, k in enumerate(sorted(of.values(), reverse=True), 1):
        n += k
        if n >= least:
            break
    return sorted(of), need


def likely(own: dict[str, list[str]], threshold: float) -> Callable[[Column], Column]:
    """Whether a text of some words can hold a template: it has a marker, and enough of the words that its bigrams begin with.

    Templates are grouped by size, each group with its markers; arrays_overlap stops at the first one.
    """
    least = {k: bounds(len(gs), threshold)[0] for k, gs in own.items()}
    groups: dict[int, list[str]] = {}
    for k, n in least.items():
        groups.setdefault(n.bit_length() // 3, []).append(k)
    tests = []
    for keys in groups.values():
        firsts = [first_words(own[k], least[k]) for k in keys]
        known = literals(sorted({w for ws, _ in firsts for w in ws}))
        some = literals(sorted({w for k in keys for w in markers(own[k], least[k])}))
        tests.append((min(least[k] for k in keys), some, known, firsts))
    either = functools.partial(functools.reduce, lambda a, b: a | b)

    def held(firsts: list[tuple[list[str], int]]) -> Callable[[Column], Column]:
        return lambda ws: either([F.size(F.array_intersect(ws, literals(first))) >= n for first, n in firsts])

    return lambda words: either([(F.size(words) > n) & F.arrays_overlap(words, some) & F.exists(F.array(F.array_intersect(words, known)), held(firsts)) for n, some, known, firsts in tests], F.lit(False))


def pairs(w: Column) -> Column:
    """The bigrams of an array of words, in order."""
    rest = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, rest), F.slice(w, 2, rest), lambda a, b: F.concat(a, F.lit(" "), b))


def best_window(k: Column, t: Fraction) -> Column:
    """(dice, shared, minus first, minus last) of the best window of `arr` for template k; places are of bigrams.

    arr holds (p, prev, upto, hit) of every bigram of the text: its place, the place where it stood before, how many
    different ones the text has up to here, and whether it is the template's. `firsts` are the places of first ones,
    `starts` the elements that runs begin with, `last` is the last place of one of the template's.
    """
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("c"), F.lit(0).alias("bc"), F.lit(1).alias("bd"), F.lit(-1).alias("to"))

    def sweep(s: Column) -> Column:
        # Beyond `most` first ones the window has too many different bigrams.
        end = F.least(F.coalesce(F.get("firsts", s["upto"] + k["most"]) - 1, F.col("last")), F.col("last"))

        def step(z: Column, x: Column) -> Column:
            new = x["prev"] < s["p"]
            n, c = z["n"] + new.cast("int"), z["c"] + (new & x["hit"]).cast("int")
            d = n + k["size"]
            good = new & x["hit"] & (2 * c.cast("long") * t.denominator >= d * F.lit(t.numerator).cast("long")) & (c.cast("long") * z["bd"] > z["bc"].cast("long") * d)
            return F.struct(n.alias("n"), c.alias("c"), F.when(good, c).otherwise(z["bc"]).alias("bc"), F.when(good, d).otherwise(z["bd"]).alias("bd"), F.when(good, x["p"]).otherwise(z["to"]).alias("to"))

        return F.aggregate(F.slice("arr", s["p"] + 1, F.greatest(end - s["p"] + 1, F.lit(1))), state, step, lambda z: F.struct((F.lit(2.0) * z["bc"] / z["bd"]).alias("dice"), z["bc"].alias("shared"), (-s["p"]).alias("first"), (-z["to"]).alias("last")))

    return F.array_max(F.transform("starts", sweep))


def matches(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id and notices, an array of (license, dice, first, last, shared) in order of license.

    Words first..last (from 0) of the text are the template's best window; shared is its number of the template's bigrams.
    """
    spark = docs.sparkSession
    t = Fraction(str(threshold))
    own = {key: bigrams(text) for key, text in sorted((TEMPLATES | TEXTS if templates is None else templates).items())}
    own = {k: gs for k, gs in own.items() if gs}
    sizes = [(k, len(gs), *bounds(len(gs), threshold)) for k, gs in own.items()]
    # Bounded by the templates, which are constants of this module or an argument held by the driver.
    grams = F.broadcast(spark.createDataFrame([(k, g) for k, gs in own.items() for g in gs], "license string, gram string"))
    size = F.broadcast(spark.createDataFrame(sizes, "license string, size int, least int, most int"))
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+")
    # Written once, so that every later step sees the same rid; texts stay only where a template is possible.
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.when(F.exists(F.array(words), likely(own, threshold)), F.col("text")).alias("text"))
    base = stored(base, "licence-rows")
    some = base.where("text IS NOT NULL").select("rid", F.filter(words, lambda w: w != "").alias("w"))
    # Bigrams of templates in a text, each once: what a template needs is counted before any window is looked at.
    held = some.select("rid", F.posexplode(pairs(F.col("w"))).alias("p", "gram")).join(grams, "gram").groupBy("rid", "license").agg(F.count_distinct("gram").alias("c"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    held = stored(held.join(size, "license").where("c >= least").select("rid", "license", "size", "most", "lo", "hi"), "licence-pairs")
    # The bigrams of the texts that stay, from the first to the last of a template's; windows of these hold one text's rows.
    spans = held.groupBy("rid").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    part = some.join(spans.hint("shuffle_hash"), "rid").select("rid", F.slice("w", F.col("lo") + 1, F.col("hi") - F.col("lo") + 2).alias("w"))
    pos = part.select("rid", F.posexplode(pairs(F.col("w"))).alias("p", "gram"))
    licenses = grams.groupBy("gram").agg(F.collect_set("license").alias("of"))
    pos = pos.join(F.broadcast(licenses), "gram", "left")
    pos = pos.withColumn("prev", F.lag("p", 1, -1).over(Window.partitionBy("rid", "gram").orderBy("p")))
    pos = pos.withColumn("upto", F.sum((F.col("prev") < 0).cast("int")).over(Window.partitionBy("rid").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    texts = pos.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("p", "prev", "upto", "of"))).alias("all"))
    begins = F.min("lo").over(Window.partitionBy("rid")).alias("from")
    texts = texts.join(held.select("*", begins), "rid").select("rid", F.struct("license", "size", "most", "from").alias("k"), F.transform(F.filter("all", lambda x: x["prev"] < 0), lambda x: x["p"]).alias("firsts"), F.transform("all", lambda x: F.struct(x["p"], x["prev"], x["upto"], F.coalesce(F.array_contains(x["of"], F.col("license")), F.lit(False)).alias("hit"))).alias("arr"))
    hits = F.filter("arr", lambda x: x["hit"])
    texts = texts.select("*", F.filter("arr", lambda x: x["hit"] & ~F.coalesce(F.get("arr", x["p"] - 1)["hit"], F.lit(False))).alias("starts"), F.element_at(hits, -1)["p"].alias("last"))
    best = texts.select("rid", "k.license", "k.from", best_window(F.col("k"), t).alias("b"))
    listed = F.sort_array(F.collect_list(F.struct("license", F.col("b.dice").alias("dice"), (F.col("from") - F.col("b.first")).alias("first"), (F.col("from") + 1 - F.col("b.last")).alias("last"), F.col("b.shared").alias("shared"))))
    found = best.groupBy("rid").agg(F.filter(listed, lambda x: x["shared"] > 0).alias("notices"))
    return base.select("rid", "doc_id").join(found, "rid", "left").select("doc_id", F.coalesce("notices", F.array().cast("array<struct<license:string,dice:double,first:int,last:int,shared:int>>")).alias("notices"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("notices").cast("long").alias("n_licenses"), F.array_join("notices.license", ",").alias("licenses"), F.round(F.coalesce(F.array_max("notices.dice"), F.lit(0.0)), 6).alias("best_dice"))


def _sql() -> str:
    """All windows that begin with a bigram of the template, without markers, runs or bounds of sizes."""
    values = ", ".join("('{}', '{}')".format(k, " ".join(v.split()).replace("'", " ")) for k, v in sorted((TEMPLATES | TEXTS).items()))
    word = r"[\p{L}\p{N}]+"
    return f"""
WITH t(license, text) AS (VALUES {values}),
tw AS (SELECT license, regexp_extract_all(lower(text), '{word}') AS w FROM t),
tg AS (SELECT DISTINCT license, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT license, w, unnest(range(1, len(w))) AS i FROM tw)),
ts AS (SELECT license, count(*) AS size FROM tg GROUP BY 1),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{word}') AS w FROM documents),
p AS (SELECT doc_id, i AS p, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
k AS (SELECT doc_id, license, count(DISTINCT gram) AS c FROM p JOIN tg USING (gram) GROUP BY 1, 2),
q AS (SELECT doc_id, license, size FROM k JOIN ts USING (license) WHERE 2 * c >= {THRESHOLD} * (c + size)),
h AS (SELECT q.doc_id, q.license, size, p.p, p.gram, tg.gram IS NOT NULL AS hit FROM q JOIN p USING (doc_id) LEFT JOIN tg ON tg.license = q.license AND tg.gram = p.gram),
f AS (SELECT s.doc_id, s.license, s.size, s.p AS s, h.gram, min(h.p) AS p, bool_or(h.hit) AS hit FROM h s JOIN h ON h.doc_id = s.doc_id AND h.license = s.license AND h.p >= s.p WHERE s.hit GROUP BY 1, 2, 3, 4, 5),
g AS (SELECT doc_id, license, hit, 2 * sum(hit::INTEGER) OVER x / (count(*) OVER x + size) AS dice FROM f WINDOW x AS (PARTITION BY doc_id, license, s ORDER BY p)),
b AS (SELECT doc_id, license, max(dice) AS dice FROM g GROUP BY 1, 2 HAVING max(dice) >= {THRESHOLD}),
r AS (SELECT doc_id, count(*) AS n, string_agg(license, ',' ORDER BY license) AS licenses, max(dice) AS dice FROM b GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_licenses, coalesce(licenses, '') AS licenses, round(coalesce(dice, 0.0), 6)::DOUBLE AS best_dice FROM documents d LEFT JOIN r USING (doc_id)"""


QUERIES = {"op3_license_scan": op3}
ORACLES = {"op3_license_scan": _sql()}
