"""Candidate pairs met in their cells, so that what a node brings is moved three times and not once a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def met(ranked: DataFrame, brought: DataFrame) -> DataFrame:
    """(x, y, p, q) of nodes x and the k nodes after them, of ranked(id, r, k, c), c being rank r in cells of length k;
    p and q are the columns of brought(id, ..) as structs. Pairs are formed by the last join and no row of them is moved."""
    columns = [c for c in brought.columns if c != "id"]
    rows = ranked.select("id", "r", "k", "c").join(brought, "id").select("id", "r", "k", "c", F.struct(*columns).alias("z"))
    one = rows.select(F.col("id").alias("x"), F.col("r").alias("_rx"), "k", F.col("z").alias("p"), F.explode(F.array(F.col("c"), F.col("c") + 1)).alias("_t"))
    two = rows.select(F.col("id").alias("y"), F.col("r").alias("_ry"), F.col("z").alias("q"), F.col("c").alias("_c"))
    on = (F.col("_t") == F.col("_c")) & (F.col("_ry") > F.col("_rx")) & (F.col("_ry") <= F.col("_rx") + F.col("k"))
    return one.join(two, on).select("x", "y", "p", "q")


def numbered(bag: Column) -> Column:
    """The members of a bag, given as an array of (b, c) with c copies of b each, told apart: as many are in two arrays as in both bags."""
    return F.flatten(F.transform(bag, lambda e: F.transform(F.sequence(F.lit(1).cast("long"), e["c"]), lambda i: e["b"] * F.lit(1 << 31) + i)))
