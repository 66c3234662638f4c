"""Idempotent sinks for micro-batches.

``foreachBatch`` may run a batch again. Each output of a batch therefore goes to a
folder named after the batch and replaces what is there; a marker written last
tells readers that all outputs of the batch are complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import LongType, StructType


def write_part(df: DataFrame, root: str, table: str, batch_id: int, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/{table}/batch_id={batch_id}")


def mark(spark: SparkSession, folder: str, batch_id: int) -> None:
    marker = spark.range(1).select(F.lit(True).alias("done"))
    marker.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


def commit(spark: SparkSession, root: str, batch_id: int) -> None:
    mark(spark, f"{root}/commits", batch_id)


def newest_marker(spark: SparkSession, folder: str) -> int | None:
    """The largest batch number marked in a folder; None without the folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    schema = StructType().add("done", "boolean").add("batch_id", LongType())
    return spark.read.schema(schema).parquet(folder).agg(F.max("batch_id")).first()[0]


def forget(spark: SparkSession, root: str, table: str, before: int) -> None:
    """Delete the folders of batches before ``before``; they are listed by name, not read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(place) if files.exists(place) else []:
        name = status.getPath().getName()
        if name.startswith("batch_id=") and int(name.removeprefix("batch_id=")) < before:
            files.delete(status.getPath(), True)


def commits(spark: SparkSession, root: str) -> DataFrame:
    """``batch_id`` of the complete batches."""
    schema = StructType().add("done", "boolean").add("batch_id", LongType())
    return spark.read.schema(schema).parquet(f"{root}/commits").select("batch_id").distinct()


def committed(spark: SparkSession, root: str, table: str, schema: StructType) -> DataFrame:
    """Rows of complete batches only."""
    with_batch = StructType([*schema.fields]).add("batch_id", LongType())
    rows = spark.read.schema(with_batch).parquet(f"{root}/{table}")
    return rows.join(commits(spark, root), "batch_id", "left_semi").drop("batch_id")


def start(writer: DataStreamWriter, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start a query: for all data there is now, or with a trigger interval such as ``10 seconds``."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def append_parquet(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append a stream to a Parquet folder; the file sink keeps its own log and is exactly-once."""
    return start(df.writeStream.format("parquet").outputMode("append").option("path", path), checkpoint, every)
