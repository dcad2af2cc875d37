"""Folders that the driver and every executor see."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers need not have it installed."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        top = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="orbweave-code-")) / f"{top.name}-graph.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent).as_posix())
        context.addPyFile(str(path))
        _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a temporary folder is set there only on one machine without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="orbweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df, spark: SparkSession, name: str):
    """df written as Parquet and read again: its lineage ends there and lost executors cost no recomputation."""
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver drop what no plan refers to any more, so that executors delete its shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of shared_dir() whose users are all written."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
