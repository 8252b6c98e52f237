"""A folder of N-Quads files, read as a stream and appended to a table of memberships.

Each micro-batch is parsed as a batch is, reduced to rows the table does not hold, and written under
its batch number, so a batch that runs again overwrites its own files and adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.sources import ntriples


def ingest(spark: SparkSession, source: str, table: str, checkpoint: str, propositions: str | None = None) -> None:
    """Take all files that are new since the last call, then return.

    Statement terms go to a table of their own beside the memberships (``table`` with "-propositions").
    """
    beside = propositions or f"{table.rstrip('/')}-propositions"

    def new(rows: DataFrame, path: str, number: int) -> None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system, keys = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), rows.columns
        if system.exists(at):
            held = spark.read.schema(", ".join([*(f"{c} string" for c in keys), "batch long"])).option("basePath", path).parquet(path)
            rows = rows.join(held.filter(f"batch != {number}").select(*keys), keys, "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    def add(batch: DataFrame, number: int) -> None:
        memberships, terms = ntriples.parse_lines(batch, scope=F.col("file_path"))
        # terms first: a membership that is there can be decoded
        new(terms, beside, number)
        new(memberships, table, number)

    lines = spark.readStream.schema("value string").text(source).select("value", "_metadata.file_path")
    stream = lines.writeStream.foreachBatch(add)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
