"""Mixing sources to target weights by a low-discrepancy schedule.

Targets share a total of tokens among the sources by weight, none above `most` times its source's tokens (water
filling). The total is cut into slots of equal blocks of tokens. Slot i has the golden-ratio point i / phi modulo 1, in
exact integers, which the cumulative target shares map to a source; a source has as many slots as points fall to it,
ranked in order, so that it comes within a few blocks of its target. The documents of a source, shuffled by hash, form
a stream of blocks that repeats; the slot of rank k takes block k. Slots meet documents on cells of the stream.

Order and ranks come from two-level prefix sums: buckets of hashes and chunks of slots are summed first, and only these
sums run through a window, so that a source with a third of all rows is spread over all tasks; a bucket that repeats
of one doc_id overfill is split by row.

Cases: null and empty texts have size 0 and are taken 0 times; a null source is a source of its own, last in order; a
source that no point falls to has one slot after the last, of its target's tokens; no source gives more than `most` times
its tokens; a total of 0 takes nothing; rows that repeat a doc_id are documents of their own; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm.common import release, stored, table, with_row_id

WEIGHTS = (5, 2, 1)
#: Tokens of a slot at most, where slots need not be more than MOST; slots at least, where there are as many tokens.
BLOCK, LEAST, MOST = 4096, 46368, 1 << 31
#: Rows that share a bucket of the shuffle, about; slots of a chunk; tokens of a cell in which slots and documents meet.
BUCKET, CHUNK, CELL = 4096, 4096, 4096
#: 2 ** 32 over the golden ratio; point i is i * GOLD modulo UNIT.
GOLD, UNIT = 2654435769, 1 << 32


def n_words(text: Column) -> Column:
    """Count of `[^\\x20\\x09-\\x0D]+` in a text, 0 for null."""
    parts = F.split(text, r"[\x20\x09-\x0D]+")
    ends = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(text.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.size(parts) - ends, F.lit(0))).cast("long")


def targets(sized: DataFrame, share: tuple[int, int] = (3, 2), weights: tuple[int, ...] = WEIGHTS, most: int = 2) -> DataFrame:
    """source, source_size and target; one row per source, so that its windows hold no more rows than there are sources.

    Sources that reach their bound are those of the least bound by weight; the others share what is left by weight.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    sums = sums.withColumn("w", w).withColumn("bound", (most * F.col("source_size")).cast("double"))
    by_bound = Window.orderBy(F.col("bound") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    sums = sums.withColumns({"left_size": F.lit(share[0] / share[1]) * F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(by_bound), F.lit(0.0)), "left_w": F.sum("w").over(whole) - F.coalesce(F.sum("w").over(by_bound), F.lit(0.0))})
    # Row j says what level the sources from j on would have; the first that holds its own row is the level.
    sums = sums.withColumn("level", F.col("left_size") / F.col("left_w"))
    sums = sums.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("bound"), F.struct((F.col("bound") / F.col("w")).alias("o"), "level"))).over(whole)["level"])
    return sums.select("source", "w", "source_size", F.least("bound", F.coalesce(F.col("w") * F.col("level"), F.col("bound"))).alias("target"))


def schedule(shares: DataFrame, n: int, gold: int = GOLD) -> DataFrame:
    """n slots of shares(sid, target, to), `to` the running sum of targets: (slot, sid, rank), ranked within a source from 0."""
    spark = shares.sparkSession
    # One row per source; the cumulative shares are looked up in cells of the unit interval, about one source each.
    head = shares.agg(F.max("to").alias("total"), F.count("*").alias("k")).first()
    cells = 1 << max(8, 2 + int(head["k"]).bit_length())
    wide = UNIT // cells
    to = shares.select("sid", F.round(F.col("to") / F.lit(head["total"] or 1.0) * UNIT).cast("long").alias("to"))
    to = to.withColumn("from", F.coalesce(F.lag("to").over(Window.orderBy("sid")), F.lit(0).cast("long"))).where("to > `from`")
    to = to.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / wide), F.floor((F.col("to") - 1) / wide))))
    slots = spark.range(0, n, 1, max(1, min(n // (16 * CHUNK) + 1, 1 << 14))).select(F.col("id").alias("slot"), F.pmod(F.col("id") * F.lit(gold), F.lit(UNIT)).alias("x"))
    slots = slots.withColumn("cell", F.floor(F.col("x") / wide)).join(to, "cell")
    slots = slots.where("x >= `from` AND x < to").select("slot", "sid", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    per = slots.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n")).drop("n")
    ranked = slots.withColumn("r", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1).join(before, ["sid", "chunk"])
    return ranked.select("slot", "sid", (F.col("before") + F.col("r")).alias("rank"))


def n_slots(total: float, block: int = BLOCK, least: int = LEAST) -> int:
    return min(max(math.ceil(total / block), least), math.ceil(total), MOST)


def mixed_spans(docs: DataFrame, rid: Column | None = None, share: tuple[int, int] = (3, 2), weights: tuple[int, ...] = WEIGHTS, most: int = 2, block: int = BLOCK, least: int = LEAST, gold: int = GOLD, seed: str = "mix") -> tuple[DataFrame, DataFrame, int]:
    """The sized rows of docs(doc_id, text, source), the schedule's spans of them, and its number of slots.

    A span (rid, slot, sid, rank, turn, begin, end) is tokens begin..end of a row in a turn of its source's stream; rid
    is a column that tells rows apart, or a number of their own.
    """
    row = F.monotonically_increasing_id() if rid is None else rid
    sized = stored(docs.select(row.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size")), "sizes")
    of = targets(sized, share, weights, most)
    of = of.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    of = stored(of.withColumn("to", F.sum("target").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))), "targets")
    total = of.agg(F.coalesce(F.max("to"), F.lit(0.0))).first()[0]
    n = n_slots(total, block, least)
    rows = sized.count()
    # Shuffled order: md5 of seed and id; its leading part deals rows to buckets, large ones are split by row.
    buckets = max(1, math.ceil(rows / BUCKET))
    o = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("rid")))), 1, 15), 16, 10).cast("long")
    line = sized.where("size > 0").join(of.select(F.col("source").alias("s"), "sid", "source_size"), F.col("source").eqNullSafe(F.col("s"))).withColumn("o", o)
    line = line.withColumn("bucket", F.floor(F.col("o") / F.lit(2**60) * buckets))
    parts = line.groupBy("sid", "bucket").agg(F.ceil(F.count("*") / (4 * BUCKET)).alias("parts"))
    line = line.join(parts.where("parts > 1"), ["sid", "bucket"], "left").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("rid"), "parts")).otherwise(0))
    per = line.groupBy("sid", "bucket", "part").agg(F.sum("size").alias("n"))
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("sid").orderBy("bucket", "part")) - F.col("n")).drop("n")
    within = Window.partitionBy("sid", "bucket", "part").orderBy("o", "doc_id", "rid")
    line = line.withColumn("end0", F.sum("size").over(within)).join(before, ["sid", "bucket", "part"])
    line = line.select("rid", "sid", "source_size", (F.col("before") + F.col("end0") - F.col("size")).alias("lo"), (F.col("before") + F.col("end0")).alias("hi"))
    # Slots as token ranges of the repeated stream, cut where it begins again; a source without a point has a slot of its own.
    wide = F.lit(total / max(n, 1))
    edge = lambda r: F.floor(r.cast("double") * wide + 0.001).cast("long")
    ranked = schedule(of.where("target > 0").select("sid", "target", "to"), n, gold)
    slots = ranked.select("slot", "sid", "rank", edge(F.col("rank")).alias("a"), edge(F.col("rank") + 1).alias("b"))
    missed = of.where("target > 0").join(ranked.select("sid").distinct(), "sid", "left_anti").select(F.lit(n).cast("long").alias("slot"), "sid", F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("a"), F.round("target").cast("long").alias("b"))
    slots = slots.unionByName(missed).join(of.select("sid", "source_size"), "sid").withColumn("b", F.least("b", F.lit(most) * F.col("source_size"))).where("b > a")
    size = F.col("source_size")
    slots = slots.withColumn("turn", F.explode(F.sequence(F.expr("a div source_size"), F.expr("(b - 1) div source_size"))))
    slots = slots.select("slot", "sid", "rank", "turn", F.greatest(F.col("a") - F.col("turn") * size, F.lit(0)).alias("a"), F.least(F.col("b") - F.col("turn") * size, size).alias("b"))
    cell = lambda lo, hi: F.explode(F.sequence(F.expr(f"{lo} div {CELL}"), F.expr(f"({hi} - 1) div {CELL}")))
    met = line.withColumn("cell", cell("lo", "hi")).join(slots.withColumn("cell", cell("a", "b")), ["sid", "cell"])
    begin, end = F.greatest("lo", "a", F.col("cell") * CELL), F.least("hi", "b", (F.col("cell") + 1) * CELL)
    spans = met.where(begin < end).select("rid", "slot", "sid", "rank", "turn", (begin - F.col("lo")).alias("begin"), (end - F.col("lo")).alias("end"))
    return sized.join(of.select(F.col("source").alias("s"), "sid", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), spans, n


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target and taken, the tokens that the mix takes."""
    sized, spans, _ = mixed_spans(docs, **parameters)
    taken = spans.groupBy("rid").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    return sized.join(taken, "rid", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixture(docs: DataFrame, **parameters) -> DataFrame:
    """docs as the mix takes them, in the order of the schedule, by partition and within: a row stands once for every
    turn of its source's stream in which tokens of it are taken, at the slot that takes the first of them; a row that is
    not taken goes. A row that the end of a source's slots cuts stands whole.
    """
    release(docs.sparkSession)
    rows = with_row_id(docs, "_orb_row")
    _, spans, n = mixed_spans(rows.select("_orb_row", "doc_id", "text", "source"), F.col("_orb_row"), **parameters)
    places = spans.groupBy(F.col("rid").alias("_orb_row"), F.col("turn").alias("_orb_turn")).agg(F.min("slot").alias("_orb_slot"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    release(docs.sparkSession)
    out = rows.join(places.hint("shuffle_hash"), "_orb_row")
    out = out.repartitionById(parts, F.least(F.floor(F.col("_orb_slot") * parts / max(n, 1)), F.lit(parts - 1)).cast("int"))
    return out.sortWithinPartitions("_orb_slot", "_orb_row", "_orb_turn").select(*docs.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op4_source_mix": op4}
ORACLES = {
    "op4_source_mix": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
t AS (SELECT *, (1.5::DOUBLE * sum(n) OVER () - coalesce(sum(2 * n) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level
  FROM s WINDOW p AS (ORDER BY 2 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, n, least(2 * n, w * (SELECT min_by(level, 2 * n / w) FROM t WHERE level * w <= 2 * n)) AS target FROM t),
e AS (SELECT *, sum(target) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto FROM g WHERE target > 0),
z AS (SELECT total, least(greatest(ceil(total / 4096.0), 46368), ceil(total), 2147483648)::BIGINT AS slots FROM (SELECT coalesce(max(upto), 0) AS total FROM e)),
u AS (SELECT e.*, total, slots, round(upto / total * 4294967296)::BIGINT AS b FROM e, z),
v AS (SELECT *, coalesce(lag(b) OVER (ORDER BY source NULLS LAST), 0) AS a FROM u),
x AS (SELECT (range * 2654435769) % 4294967296 AS x FROM range((SELECT slots FROM z))),
c AS (SELECT source, n, target, total, slots, count(x.x) AS k FROM v LEFT JOIN x ON x.x >= v.a AND x.x < v.b GROUP BY ALL),
o AS (SELECT source, CASE WHEN k > 0 THEN least(floor(k * (total / slots) + 0.001), 2 * n) ELSE round(target) END::BIGINT AS goal FROM c),
l AS (SELECT d.*, g.n, g.target, coalesce(o.goal, 0) AS goal, sum(size) OVER (PARTITION BY d.source ORDER BY ('0x' || substr(md5('mix:' || doc_id), 1, 15))::BIGINT) - size AS lo
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN o ON o.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, n::BIGINT AS source_size, target, (CASE WHEN n > 0 THEN (goal // n::BIGINT) * size + greatest(0, least(lo + size, goal % n::BIGINT) - lo) ELSE 0 END)::BIGINT AS taken FROM l"""
}
