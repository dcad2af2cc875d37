"""One SQL text for Spark and for the oracle: the few functions that differ are written as @name(argument)@."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orbweave.functions.shared import written as stored

TABLES = ("lineitem", "events", "embeddings", "part")
_SPARK = {
    "u": "(cast(conv(substr(md5({0}), 1, 8), 16, 10) AS DOUBLE) / 4294967296.0)",
    "list": "array_join(array_sort(collect_list({0})), '_')",
    "epoch": "unix_timestamp({0})",
    "sq_dist": "aggregate(zip_with({0}, (x, y) -> (cast(x AS DOUBLE) - y) * (cast(x AS DOUBLE) - y)), cast(0 AS DOUBLE), (s, v) -> s + v)",
    "dims": "posexplode({0}) AS (k, x)",
    "range": "range({0})",
}
_ORACLE = {
    "u": "(('0x' || substr(md5({0}), 1, 8))::BIGINT / 4294967296.0)",
    "list": "array_to_string(list_sort(list({0})), '_')",
    "epoch": "floor(epoch({0}))::BIGINT",
    "sq_dist": "list_sum(list_transform(list_zip({0}), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2])))",
    "range": "(SELECT range AS id FROM range({0}))",
    "dims": "unnest(range(0, len({0})))::INTEGER AS k, unnest({0}) AS x",
}


def written(sql: str, words: dict[str, str]) -> str:
    """sql with the words of one engine; decimal literals become doubles, and sums of integers stay 64-bit."""
    sql = re.sub(r"@(\w+)\((.*?)\)@", lambda m: words[m[1]].format(m[2]), sql, flags=re.S)
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", sql)


def ranked(rows: str, cell: str, order: str) -> str:
    """Common table expressions for ranks of rows(.., cell) in the order of (cell, order) without a window over all rows:
    cc counts cells, cb sums the counts before, and rk adds the place within the cell, as r from 1, and the total."""
    return (
        f"cc AS (SELECT {cell}, count(*) AS c FROM {rows} GROUP BY {cell}), cb AS (SELECT {cell}, sum(c) OVER (ORDER BY {cell}) - c AS before, sum(c) OVER () AS total FROM cc), "
        f"rk AS (SELECT x.*, cast(cb.before + row_number() OVER (PARTITION BY {', '.join('x.' + c.strip() for c in cell.split(','))} ORDER BY {order}) AS BIGINT) AS r, cast(cb.total AS BIGINT) AS total FROM {rows} x JOIN cb ON "
        + " AND ".join(f"cb.{c.strip()} = x.{c.strip()}" for c in cell.split(","))
        + ")"
    )


def graph() -> str:
    """Parts of one order on neighbouring lines, over all of lineitem, as common table expressions: e(src < dst), adj(u, v), n(id, deg)."""
    return (
        "WITH e AS (SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS src, greatest(a.l_partkey, b.l_partkey) AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey), "
        "adj AS (SELECT src AS u, dst AS v FROM e UNION ALL SELECT dst AS u, src AS v FROM e), n AS (SELECT u AS id, count(*) AS deg FROM adj GROUP BY u)"
    )


#: Common table expressions that Spark writes once per session and folder; all later users read the Parquet files.
KEPT = {"e", "adj", "n", "t3", "ego", "nb", "s5", "pos", "hop", "cand", "heat", "w1", "w2", "d", "ee", "orb", "hw", "l1", "l2", "l3", "l4"}
_views: dict[tuple[str, str], str] = {}


def parts(sql: str) -> tuple[list[tuple[str, str]], str]:
    """The common table expressions of a text (name, body), in order, and the statement after them; recursive ones stay in the statement."""
    out, at = [], 0
    if not (m := re.match(r"\s*WITH\s+(?!RECURSIVE\b)", sql)):
        return out, sql
    at = m.end()
    while m := re.compile(r"(\w+) AS \(").match(sql, at):
        depth, i, quoted = 1, m.end(), False
        while depth:
            c = sql[i]
            quoted ^= c == "'"
            depth += 0 if quoted else (c == "(") - (c == ")")
            i += 1
        out.append((m[1], sql[m.end() : i - 1]))
        more = re.compile(r"\s*,\s*").match(sql, i)
        if not more:
            return out, sql[i:]
        at = more.end()
    raise ValueError(f"no name at {sql[at : at + 40]!r}")


def _with(ctes: list[tuple[str, str]], rest: str) -> str:
    return ("WITH " + ", ".join(f"{n} AS ({b})" for n, b in ctes) + " " if ctes else "") + rest


def planned(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a text whose shared parts are tables: a graph, its walks or its layers are computed once, not inlined."""
    ctes, rest = parts(sql)
    done: list[tuple[str, str]] = []
    needs: dict[str, str] = {}
    for i, (name, body) in enumerate(ctes):
        later = " ".join([b for _, b in ctes[i + 1 :]] + [rest])
        own = [n for n, _ in done if re.search(rf"\b{n}\b", body)]
        needs[name] = hashlib.sha1("|".join([*(needs[n] for n in own), name, body]).encode()).hexdigest()
        if name in KEPT and re.search(rf"\b{name}\b", later):
            key = (f"{spark.sparkContext.applicationId} {sf_dir}", needs[name])
            if key not in _views:
                view = f"orb_{name}_{uuid.uuid4().hex[:12]}"
                stored(spark.sql(_with(done, body)), spark, f"kept-{name}").createOrReplaceTempView(view)
                _views[key] = view
            body = f"SELECT * FROM {_views[key]}"
        done.append((name, body))
    return spark.sql(_with(done, rest))


def query(sql: str, ranks: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """The query of a text; `ranks` is a column of ranks, which Spark counts in 32 bits and the oracle in 64."""
    text = written(sql, _SPARK)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        out = planned(spark, sf_dir, text)
        return out.withColumn(ranks, out[ranks].cast("bigint")) if ranks else out

    return run


def oracle(sql: str) -> str:
    """The oracle's text, in which shared parts are computed once as well."""
    text = written(sql, _ORACLE)
    if "MATERIALIZED" in text:
        return text
    ctes, rest = parts(text)
    if not ctes:
        return rest
    return "WITH " + ", ".join(f"{n} AS {'MATERIALIZED ' * (n in KEPT)}({b})" for n, b in ctes) + " " + rest
