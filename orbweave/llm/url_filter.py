"""URL filter by a temporal list: dated entries become validity intervals, and captures meet those of their time.

An entry (pattern, action, since) holds from its date until the pattern's next entry. Patterns are a host with all its
subdomains (`example.com`), or a host with a path prefix (`example.com/a/`). A capture is tried under every suffix of
its host and every directory prefix of its path; of the entries active at fetch time the longest pattern decides.
Intervals are cut by month, so that an as-of join is an equality join on (pattern, month) with a check of the interval;
a hot host is split by AQE, and captures are narrow rows.

Cases: null and empty urls, and urls without a host, match nothing and are allowed; a null fetch time likewise; of
entries that repeat a pattern and date the last action in order (`allow` before `block`) holds; null patterns or dates
are left out; ties of length go to the path; rows that repeat are kept; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm.common import table

OPEN_END = "9999-12-31 00:00:00"


def host_of(url: Column) -> Column:
    """The lower-cased host without user, port and a final dot; '' if there is none."""
    return F.coalesce(F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), r"\.$", "")), F.lit(""))


def patterns_of(host: Column, path: Column) -> Column:
    """All host suffixes, and host/prefix/ for every directory of the path."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split(path, "/")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(hosts, paths)))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, since, until of entries(pattern, action, since); a pattern's entries are few by nature."""
    rows = entries.where("pattern IS NOT NULL AND since IS NOT NULL AND action IS NOT NULL").groupBy("pattern", "since").agg(F.max("action").alias("action"))
    following = F.lead("since").over(Window.partitionBy("pattern").orderBy("since"))
    return rows.withColumn("until", F.coalesce(following, F.lit(OPEN_END).cast("timestamp")))


def filtered(captures: DataFrame, entries: DataFrame, horizon: Column | None = None) -> DataFrame:
    """One row per row of captures(page_id, url, fetched): page_id, host, verdict, pattern, since.

    horizon: a time that no capture is after; intervals without an end are cut there.
    """
    last = horizon if horizon is not None else F.lit(captures.agg(F.max("fetched")).first()[0]).cast("timestamp")
    month = lambda t: (F.year(t) * 12 + F.month(t)).cast("int")
    held = intervals(entries).where(F.col("since") <= last)
    held = held.withColumn("month", F.explode(F.sequence(month(F.col("since")), F.greatest(month(F.col("since")), month(F.least("until", last))))))
    path = F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)
    rows = captures.select(F.monotonically_increasing_id().alias("rid"), "page_id", F.coalesce("url", F.lit("")).alias("url"), "fetched").select("rid", "page_id", host_of(F.col("url")).alias("host"), F.regexp_replace(path, "/[^/]*$", "").alias("dir"), "fetched")
    tried = rows.select("rid", "page_id", "host", "fetched", month(F.col("fetched")).alias("month"), F.explode_outer(patterns_of(F.col("host"), F.col("dir"))).alias("pattern"))
    met = tried.join(held, ["pattern", "month"], "left")
    active = (F.col("since") <= F.col("fetched")) & (F.col("fetched") < F.col("until"))
    top = F.max(F.when(active, F.struct(F.length("pattern").alias("n"), "pattern", "action", "since"))).alias("top")
    # (rid) groups hold as many rows as a URL has parts.
    out = met.groupBy("rid", "page_id", "host").agg(top, F.count(F.when(active, 1)).alias("n_active"))
    return out.select("page_id", "host", F.coalesce("top.action", F.lit("allow")).alias("verdict"), F.col("top.pattern").alias("pattern"), F.col("top.since").alias("since"), "n_active")


def sample_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of pages: hosts and their parents are blocked and allowed again by the hash of the name."""
    host = host_of(F.col("url"))
    hosts = pages.select(F.explode(F.array(host, F.regexp_replace(host, r"^[^.]*\.", ""), F.concat(host, F.lit("/en/")))).alias("pattern")).where("pattern LIKE '%.%'").distinct()
    h = lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("int")
    turns = hosts.select("pattern", F.explode(F.sequence(F.lit(0), F.pmod(h(F.col("pattern")), F.lit(4)))).alias("k"))
    one = h(F.concat_ws("#", "pattern", "k"))
    day = F.date_add(F.lit("2023-07-01").cast("date"), F.pmod(one, F.lit(500)))
    return turns.select("pattern", F.when(F.pmod(one, F.lit(3)) == 0, "block").otherwise("allow").alias("action"), day.cast("timestamp").alias("since"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, fetched at a time that follows from page_id, against the list of their hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.timestamp_seconds(F.lit(1_693_526_400) + F.pmod(F.col("page_id") * 7919, F.lit(31_536_000)))
    return filtered(pages.withColumn("fetched", fetched), sample_list(pages), F.lit("2024-09-01").cast("timestamp"))


QUERIES = {"op7_url_filter": op7}
ORACLES = {
    "op7_url_filter": r"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1), '/[^/]*$', '') AS dir,
  to_timestamp(1693526400 + (page_id * 7919) % 31536000)::TIMESTAMP AS fetched FROM pages),
h AS (SELECT DISTINCT pattern FROM (SELECT unnest([host, regexp_replace(host, '^[^.]*\.', ''), host || '/en/']) AS pattern FROM p) WHERE pattern LIKE '%.%'),
k AS (SELECT pattern, unnest(range(0, ('0x' || substr(md5(pattern), 1, 7))::BIGINT % 4 + 1)) AS k FROM h),
v AS (SELECT pattern, ('0x' || substr(md5(pattern || '#' || k), 1, 7))::BIGINT AS v FROM k),
e AS (SELECT pattern, since, max(action) AS action FROM (SELECT pattern, CASE WHEN v % 3 = 0 THEN 'block' ELSE 'allow' END AS action, (DATE '2023-07-01' + (v % 500)::INTEGER)::TIMESTAMP AS since FROM v) GROUP BY 1, 2),
i AS (SELECT *, coalesce(lead(since) OVER (PARTITION BY pattern ORDER BY since), TIMESTAMP '9999-12-31') AS until FROM e),
m AS (SELECT p.page_id, i.*, row_number() OVER (PARTITION BY p.page_id ORDER BY length(i.pattern) DESC, i.pattern DESC) AS r, count(*) OVER (PARTITION BY p.page_id) AS n
  FROM p JOIN i ON (p.host = i.pattern OR ends_with(p.host, '.' || i.pattern) OR (i.pattern LIKE '%/' AND starts_with(p.host || p.dir || '/', i.pattern))) AND i.since <= p.fetched AND p.fetched < i.until)
SELECT p.page_id, p.host, coalesce(m.action, 'allow') AS verdict, m.pattern, m.since, coalesce(m.n, 0)::BIGINT AS n_active FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.r = 1"""
}
