"""Shared pieces of the training-data operators: scratch tables, batch sizes, text reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes an Arrow batch may hold.
BATCH_ROWS = 256
BATCH_BYTES = 16_000_000
#: Bytes of input for each range of an order.
RANGE_BYTES = 64_000_000


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Keep Arrow batches small, so a worker's memory is bounded by a few texts.

    Spark reads both settings when a plan is made, which is after the operator has returned it, so
    they stay set. They change how rows are passed to workers, never results.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def ranges(df: DataFrame, size: int = RANGE_BYTES) -> int:
    """How many ranges to deal df's rows into: by the bytes its files have, and no fewer than shuffles have."""
    stats = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(str(stats)) // size, 1_000_000))


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir; a local one only where that is unset and all runs here."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, if it exists."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_written(*tables: DataFrame) -> None:
    """Delete tables made by written() that no later plan reads."""
    for df in tables:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            removed(df.sparkSession, f)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, text string) of docs, whatever other columns it has."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
