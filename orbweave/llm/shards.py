"""Shards by measured bytes: ranges of a key that depend on the data alone, and rows dealt to them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.common import stored

#: Bytes of a shard at the least; shards at the most.
SHARD, SHARDS = 8 << 20, 1 << 16


def boundaries(sized: DataFrame, least: int = SHARD, most: int = SHARDS) -> list[int]:
    """First keys of all shards but the first, of sized(key long, n long): a shard holds about max(least, total / most) bytes.

    The bytes before a key are exact, from sums by range of keys and then within each, so that neither sampling nor the
    number of partitions moves a boundary. Rows of one key share a shard; null keys come first. The driver holds a number
    a partition and a number a shard.
    """
    spark = sized.sparkSession
    per = sized.where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n"))
    per = stored(per.repartitionByRange("key").select("key", "n", F.spark_partition_id().alias("part")), "keys")
    sums = per.groupBy("part").agg(F.min("key").alias("first"), F.sum("n").alias("n")).orderBy("first").collect()
    wide = max(least, -(-sum(r["n"] for r in sums) // most))
    starts, total = [], 0
    for r in sums:
        starts.append((r["part"], total))
        total += r["n"]
    if total <= wide:
        return []
    ends = per.join(F.broadcast(spark.createDataFrame(starts, "part int, before long")), "part")
    begin = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("key")) - F.col("n")
    firsts = ends.select("key", F.floor(begin / wide).alias("shard")).groupBy("shard").agg(F.min("key").alias("first"))
    return sorted(r["first"] for r in firsts.collect())[1:]


def dealt(rows: DataFrame, key: str, firsts: list[int], *order: str) -> DataFrame:
    """rows with their `shard`, a partition each, in order within."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(firsts)  # a number a shard

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        import numpy as np

        at = np.searchsorted(np.array(held.value, np.int64), keys.fillna(0).to_numpy(np.int64), "right")
        return pd.Series(np.where(keys.isna(), 0, at))

    at: Column = shard(key) if firsts else F.lit(0)
    return rows.withColumn("shard", at).repartitionById(len(firsts) + 1, F.col("shard")).sortWithinPartitions(*order)
