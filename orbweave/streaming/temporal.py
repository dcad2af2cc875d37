"""Temporal edges as a stream: windowed degrees with a watermark, kept whole by the last update of each window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.shared import shared_dir


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a file stream; its times are read in the session's zone."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", False).parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def window_degrees(stream: DataFrame, width: str = "1 day", late: str = "30 days") -> DataFrame:
    """Events and distinct-by-type activity of each user in tumbling windows; rows later than the watermark are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("purchases"))


def drained(spark: SparkSession, out: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run a stream over what is there now, in update mode, and return the last row of each key. Each micro-batch is its
    own folder, overwritten if the batch is repeated after a failure, so that restarts count nothing twice."""
    path, marks = shared_dir(spark, name), shared_dir(spark, f"{name}-marks")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    out.writeStream.outputMode("update").option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    rows = spark.read.option("basePath", path).parquet(path)
    value = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*value), "batch").alias("v")).select(*keys, "v.*")
