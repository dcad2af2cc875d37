"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of the white-space word rule `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset on one machine."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='orbweave-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back; lost executors then cost a re-read only."""
    return stored_at(df, fresh_dir(df.sparkSession, what))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_id(docs: DataFrame, name: str) -> DataFrame:
    """docs written once with a column that tells its rows apart, so that a verdict on a row meets that row only."""
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def release(spark: SparkSession) -> None:
    """Let the driver drop what no plan refers to any more, so that executors delete its shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that stored() wrote and that all users of are written."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent).as_posix())
    path = Path(tempfile.mkdtemp(prefix="orbweave-code-")) / f"{top.name}.zip"
    path.write_bytes(out.getvalue())
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def small_batches(spark: SparkSession, rows: int = 4096, mb: int = 8) -> None:
    """Bound what a Python worker holds of a partition at once; the workers get this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def fold(doc_id: Column) -> Column:
    """crc32 of the decimal doc_id, modulo 5; 0 marks held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def text_words(text: Column) -> Column:
    """Words of the white-space rule, [] for null and for empty texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
