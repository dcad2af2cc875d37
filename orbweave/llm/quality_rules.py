"""Quality rules: a table of thresholds compiled into one projection.

Cases: null and empty texts have no words and fail; ratios of nothing are 0; very long texts are measured whole;
repeated rows are kept; other columns are ignored. Equality of 3-word windows is that of their 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import table

# Frequent function words of the languages served.
STOP_WORDS = (
    "the be to of and that have with in is it for was on are as this by at from or an a "
    "der die das und ist ein eine nicht mit für auf den von zu im dem des sich auch als "
    "le la les de et des un une est que pour dans en du pas sur avec par au ce "
    "el los las del y que una por con para es se su como más al lo"
).split()
#: (measure, least, most); None is no bound.
RULES: list[tuple[str, float | None, float | None]] = [
    ("n_words", 50, 1_000_000),
    ("mean_word_chars", 2.0, 15.0),
    ("symbol_ratio", None, 0.5),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.5),
]


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def measured(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with the counts of each whole text; arrays that several measures use are projected once."""
    get = F.get
    raw = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("*", F.split("t", r"[\x20\x09-\x0D]+").alias("w0"))
    front = F.when(get("w0", F.lit(0)) == "", 1).otherwise(0)
    back = F.when((F.size("w0") > 1) & (get("w0", F.size("w0") - 1) == ""), 1).otherwise(0)
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = raw.select("doc_id", "t", F.slice("w0", 1 + front, F.size("w0") - front - back).alias("w"), lines.alias("lines"))
    grams = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(get("w", i), get("w", i + 1), get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    cut = cut.select("*", grams.alias("g"))
    # Windows found twice, by sorting; their places; the words that these cover.
    some = F.size(F.array_distinct("g")) < F.size("g")
    ordered = F.when(some, F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    cut = cut.select("*", ordered.alias("s"))
    twice = F.filter("s", lambda x, i: (x.h == get("s", i - 1).h) | (x.h == get("s", i + 1).h))
    cut = cut.select("*", F.array_sort(F.transform(twice, lambda x: x.i)).alias("p"))
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(get("p", i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return cut.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("w", lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
    )


def judged(docs: DataFrame, rules: list[tuple[str, float | None, float | None]] = RULES) -> DataFrame:
    """The counts, base_failed, kept, and the names of the rules that a row breaks."""
    c = F.col
    found = measured(docs)
    measures = {
        "n_words": c("n_words").cast("double"),
        "mean_word_chars": ratio(c("word_chars"), c("n_words")),
        "symbol_ratio": ratio(c("n_symbols"), c("n_words")),
        "stop_word_ratio": ratio(c("n_stop_words"), c("n_words")),
        "dup_line_ratio": ratio(c("n_dup_lines"), c("n_lines")),
        "bullet_line_ratio": ratio(c("n_bullet_lines"), c("n_lines")),
        "ellipsis_line_ratio": ratio(c("n_ellipsis_lines"), c("n_lines")),
    }
    broken = [F.when((measures[m] < F.lit(lo) if lo is not None else F.lit(False)) | (measures[m] > F.lit(hi) if hi is not None else F.lit(False)), F.lit(m)) for m, lo, hi in rules]
    base = (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))
    found = found.select("*", base.alias("base_failed"), F.array_compact(F.array(*broken)).alias("broken"))
    return found.withColumn("kept", ~c("base_failed") & (F.size("broken") == 0))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("broken", ",").alias("broken"))


def _sql() -> str:
    measures = {"n_words": "n_words", "mean_word_chars": "coalesce(word_chars / n_words, 0)", "symbol_ratio": "coalesce(n_symbols / n_words, 0)", "stop_word_ratio": "coalesce(n_stop / n_words, 0)", "dup_line_ratio": "coalesce(n_dup_lines / n_lines, 0)", "bullet_line_ratio": "coalesce(n_bullet / n_lines, 0)", "ellipsis_line_ratio": "coalesce(n_ellipsis / n_lines, 0)"}
    tests = ", ".join(f"CASE WHEN {' OR '.join(x for x in (lo is not None and f'{measures[m]} < {lo}', hi is not None and f'{measures[m]} > {hi}') if x)} THEN '{m}' END" for m, lo, hi in RULES)
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return rf"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i : i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY 1),
m AS (SELECT a.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  len(l) AS n_lines, len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop, len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet,
  len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis FROM a LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, array_to_string(list_filter([{tests}], lambda x: x IS NOT NULL), ',') AS broken FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, broken FROM b"""


QUERIES = {"op1_quality_rules": op1}
ORACLES = {"op1_quality_rules": _sql()}
