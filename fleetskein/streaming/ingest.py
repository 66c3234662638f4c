"""Continuous ingest: messages to ledger, artifact log, traces and quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from fleetskein import schemas
from fleetskein.operators import artifacts
from fleetskein.sources import decode
from fleetskein.sources.messages import FIREHOSE_FILTER, REGISTRY_FILTER, telemetry_route
from fleetskein.streaming import sinks

_OUTPUTS = {"ledger": schemas.LEDGER, "artifact_log": schemas.ARTIFACT_LOG, "traces": schemas.TRACES}


def write_events(messages: DataFrame, root: str, batch_id: int) -> None:
    """Split one batch of telemetry messages into its four tables and mark it complete."""
    decoded = decode.decode(messages).persist()
    try:
        ledger = decode.ledger_rows(decoded)
        # One task per date and slice of nodes: few files, each sorted for min/max skipping.
        slices = F.pmod(F.xxhash64("node_id", "event_id"), F.lit(16))
        ordered = ledger.repartition("event_date", slices).sortWithinPartitions("event_date", "node_id", "event_timestamp")
        sinks.write_part(ordered, root, "ledger", batch_id, ["event_date"])
        sinks.write_part(decode.artifact_rows(decoded), root, "artifact_log", batch_id)
        sinks.write_part(decode.trace_rows(decoded), root, "traces", batch_id)
        sinks.write_part(decode.quarantine(decoded), root, "quarantine", batch_id)
        sinks.commit(messages.sparkSession, root, batch_id)
    finally:
        decoded.unpersist()


def start_ingest(
    messages: DataFrame,
    root: str,
    checkpoint: str,
    every: str | None = None,
    firehose: str = FIREHOSE_FILTER,
    registry: str = REGISTRY_FILTER,
    redelivered_within: str | None = None,
) -> StreamingQuery:
    """Run the ingest on a stream of messages. Late rows are stored like any other.

    With ``redelivered_within`` (such as ``1 hour``) a content that was taken in less than that ago is not taken in again.
    """
    routed = telemetry_route(messages, firehose, registry)
    if redelivered_within:
        routed = without_redeliveries(routed, redelivered_within)
    writer = routed.writeStream.foreachBatch(lambda batch, batch_id: write_events(batch, root, batch_id))
    return sinks.start(writer, checkpoint, every)


def without_redeliveries(messages: DataFrame, within: str) -> DataFrame:
    """Each (topic, payload) once; the state forgets a content ``within`` after it was taken in.

    The watermark follows the time of the batch, not the rows' own times: no row is ever late, so none is lost, and
    the state holds the contents of that time and no more, however old the messages are.
    """
    taken = messages.withColumn("_taken", F.current_timestamp()).withWatermark("_taken", within)
    return taken.dropDuplicatesWithinWatermark(["topic", "payload"]).drop("_taken")


def update_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """Merge the artifact log of batches since the last snapshot into a new one, and return it (``artifacts.current`` reads it).

    A snapshot lies in a folder named after the last batch it holds, and only that log which came after the
    snapshot before is read. A folder that is not marked in ``snapshots`` is not read, and is replaced by the next call.
    """
    done = sinks.commits(spark, root)
    newest = done.agg(F.max("batch_id")).first()[0]
    last = sinks.newest_marker(spark, f"{root}/snapshots")
    if newest is None or newest == last:
        return spark.read.schema(artifacts.SNAPSHOT).parquet(f"{root}/artifact_snapshot/upto={last}") if last is not None else spark.createDataFrame([], artifacts.SNAPSHOT)
    log = spark.read.schema(StructType([*schemas.ARTIFACT_LOG.fields, StructField("batch_id", LongType())])).parquet(f"{root}/artifact_log")
    fresh = log.filter(F.col("batch_id") > (-1 if last is None else last)).join(done, "batch_id", "left_semi").drop("batch_id")
    parts = [artifacts.snapshot(fresh)]
    if last is not None:
        parts.append(spark.read.schema(artifacts.SNAPSHOT).parquet(f"{root}/artifact_snapshot/upto={last}"))
    place = f"{root}/artifact_snapshot/upto={newest}"
    artifacts.merge(*parts).write.mode("overwrite").parquet(place)
    sinks.mark(spark, f"{root}/snapshots", newest)
    return spark.read.schema(artifacts.SNAPSHOT).parquet(place)


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """``ledger``, ``artifact_log`` or ``traces`` of the complete batches."""
    return sinks.committed(spark, root, table, _OUTPUTS[table])


def append_ledger(ledger: DataFrame, path: str) -> None:
    """Append ledger rows to a date-partitioned table outside the stream."""
    dated = ledger if "event_date" in ledger.columns else ledger.withColumn("event_date", F.to_date("event_timestamp"))
    slices = F.pmod(F.xxhash64("node_id", "event_id"), F.lit(64))
    (
        dated.repartition("event_date", slices)
        .sortWithinPartitions("event_date", "node_id", "event_timestamp")
        .write.mode("append")
        .partitionBy("event_date")
        .parquet(path)
    )


def compact_ledger(spark: SparkSession, root: str, path: str) -> None:
    """Rewrite the complete batches as one table of few files per date, replacing ``path``."""
    rows = read_table(spark, root, "ledger")
    slices = F.pmod(F.xxhash64("node_id", "event_id"), F.lit(64))
    (
        rows.repartition("event_date", slices)
        .sortWithinPartitions("event_date", "node_id", "event_timestamp")
        .write.mode("overwrite")
        .partitionBy("event_date")
        .parquet(path)
    )
